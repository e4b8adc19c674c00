"""Helpers shared by the operators of this subpackage."""

import tempfile
import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: A word is a run of bytes other than space and the five ASCII controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text):
    """Words of a text column, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ensure_checkpoint_dir(spark):
    """Use the cluster's shared checkpoint folder; only a local session without one (tests) takes a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="loomwork-checkpoint-"))


def whole_vectors(table, scale=256):
    """``table`` with x, its ``embedding`` as long floor(scale * c), c as double; rows that are null, empty or hold null or non-finite
    entries go, and those of another length than the commonest (of equally common ones the shorter)."""
    fine = table.where("embedding is not null and size(embedding) > 0").withColumn("x", F.transform("embedding", lambda v: v.cast("double")))
    fine = fine.where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    fine = fine.withColumn("x", F.transform("x", lambda v: F.floor(v * float(scale)) + F.lit(0).cast("long"))).drop("embedding")
    usual = fine.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return fine.where(F.size("x") == (usual["n"] if usual else 0))


def matrix(column, dtype="float64"):
    """A column of equally long arrays as rows of a matrix."""
    return np.array(column.tolist(), dtype).reshape(len(column), -1)


def stored(df, name):
    """``df`` written as Parquet below the checkpoint folder and read again."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def crc_mod(doc_id, m):
    """crc32 of the id as text, modulo m; null ids count as the text ''."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(m))


def crc_mod_py(doc_id, m):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % m


def partitions(spark):
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Up to so many edges one task finishes a graph by union-find.
FEW_EDGES = 50_000


def _union_find(pdf):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    return pd.DataFrame({"n": nodes, "to": [root(x) for x in nodes]})


def components(edges, few=FEW_EDGES):
    """Connected components of ``edges(a, b)`` (long ids): returns ``(id, component)``, component the smallest id.

    Random-priority contraction: every node points at the neighbour (itself included) of least
    pseudo-random rank, edges are renamed by that pointer and the rest repeats. A round removes a constant
    share of the nodes in expectation, whatever the shape (chains, stars), and is a partially aggregated
    minimum and plain equi-joins. Once at most ``few`` edges are left, a bound that doesn't grow with the
    input, one task solves them; the result is the same. Every round is cut with checkpoint(). Null
    ends and self-links are ignored; no edges give an empty result.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    edges = edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().checkpoint()
    at = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().select("id", F.col("id").alias("root"))
    rank = lambda c, salt: F.struct(F.xxhash64(F.lit(salt), F.col(c)).alias("h"), F.col(c).alias("id"))
    salt = 0
    while edges.count() > few:
        both = edges.union(edges.select("b", "a"))
        point = both.groupBy(F.col("a").alias("n")).agg(F.min(rank("b", salt)).alias("best"))
        point = point.select("n", F.least("best", rank("n", salt))["id"].alias("to")).checkpoint()
        at = at.join(point, F.col("root") == F.col("n"), "left").select("id", F.coalesce("to", "root").alias("root")).checkpoint()
        edges = edges.join(point.selectExpr("n as a", "to as ta"), "a").join(point.selectExpr("n as b", "to as tb"), "b").where("ta <> tb")
        edges = edges.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct().checkpoint()
        salt += 1
    last = edges.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(_union_find, "n long, to long")
    at = at.join(last, F.col("root") == F.col("n"), "left").select("id", F.coalesce("to", "root").alias("root"))
    if salt == 0:  # union-find took the smallest id for the root
        return at.select("id", F.col("root").alias("component")).checkpoint()
    at = at.checkpoint()
    return at.join(at.groupBy("root").agg(F.min("id").alias("component")), "root").select("id", "component").checkpoint()
