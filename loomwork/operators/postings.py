"""A stored inverted index for BM25: postings in blocks with bounds, deltas of added and removed documents, top-k search that skips blocks.

Documents are dealt to ranges of about ``RANGE`` with like lengths. A block holds a term's postings of one range, so no term is a hot key, with the
greatest frequency and the least length in it: these bound the score of every document of the range for any statistics. A search
scores each query's most promising ranges, and then only those whose bound reaches the k-th best score found there.

Below ``path`` lie Parquet tables: ``blocks``, ``terms`` and ``forward`` (by generation and bucket), ``stats``, ``removed`` and ``meta``. A write adds one generation; its row
in ``meta``, with the format's version, comes last, so what a broken write left is never read. There is one writer at a time.
"""

import uuid
from collections import namedtuple

from pyspark.errors import AnalysisException
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwork.operators import bm25
from loomwork.operators.lineage import cut

VERSION, RANGE = 1, 1024
#: Parts to which documents, then their terms, are dealt for a write, by bucket; groups of buckets, to which a document's terms are sent together.
PARTS, GROUPS = 256, 8
#: A query's first ranges are k, and so many at least: each may hold only one of the best documents.
FIRST = 2


#: The tables' columns; {} is the type of doc_id.
SCHEMAS = {
    "forward": "doc_id {}, len long, terms array<struct<term:string,tf:long>>, gen long, bucket int",
    "blocks": "term string, span long, max_tf long, min_len long, postings array<struct<doc_id:{},tf:long,len:long>>, gen long, bucket int",
    "terms": "term string, df long, cf long, gen long, bucket int",
    "stats": "n long, total long, gen long",
    "removed": "doc_id {}, gen long",
}
Index = namedtuple("Index", "path gens buckets id_type")


def _bucket(column, index):
    return F.pmod(F.xxhash64(column), F.lit(index.buckets)).cast("int")


def opened(spark, path):
    """The index at ``path``, None if there is none. Another version is refused."""
    try:
        rows = spark.read.parquet(f"{path}/meta").distinct().collect()  # one for each write
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None
    odd = {r["version"] for r in rows} - {VERSION}
    if odd:
        raise ValueError(f"unsupported format version: {sorted(odd)[0]}")
    return Index(path, sorted(r["gen"] for r in rows), rows[0]["buckets"], rows[0]["id_type"])


def _next(index):
    """A generation after all others, of another number than what a broken write may have left."""
    return ((max([0, *index.gens]) >> 20) + 1 << 20) + (uuid.uuid4().int & (1 << 20) - 1)


def _read(spark, index, name, gens=None):
    return spark.read.schema(SCHEMAS[name].format(index.id_type)).parquet(f"{index.path}/{name}").where(F.col("gen").isin(gens or index.gens))


def _write(df, index, name, gen, dealt=False):
    """Adds rows to a table; ``dealt``: those of a bucket already lie in few partitions."""
    by = ["gen", "bucket"] if "bucket" in SCHEMAS[name] else ["gen"]
    df = df.withColumn("gen", F.lit(gen))
    if "bucket" in by:
        df = df.withColumn("bucket", _bucket(df.columns[0], index))
        df = (df if dealt else df.hint("rebalance", "bucket")).sortWithinPartitions("gen", "bucket", df.columns[0])
    df.write.mode("append").partitionBy(*by).parquet(f"{index.path}/{name}")


def _finish(spark, index, gen):
    row = [(VERSION, gen, index.buckets, index.id_type)]
    spark.createDataFrame(row, "version int, gen long, buckets int, id_type string").coalesce(1).write.mode("append").parquet(f"{index.path}/meta")


def add(docs, path, buckets=64):
    """Adds ``docs(doc_id, text)`` as a generation; documents of these ids that are there already are replaced. The first write fixes the number of buckets.

    Rows that repeat an id count as one document with the first text in order; null ids are left out; null texts are empty documents.
    """
    spark = docs.sparkSession
    if opened(spark, path):
        remove(docs.select("doc_id"), path)
    index = opened(spark, path) or Index(path, [], buckets, docs.schema["doc_id"].dataType.simpleString())
    gen = _next(index)
    # one shuffle of the texts, by bucket and a part of it, in which documents are made one, counted and written
    part = lambda column, groups: F.pmod(F.xxhash64(F.lit(3), column), F.lit(-(-PARTS // groups)))
    at = ["_bucket", "_part", "doc_id"]
    dealt = docs.where("doc_id is not null").select("doc_id", "text", _bucket("doc_id", index).alias("_bucket"), part("doc_id", index.buckets).alias("_part")).repartition("_bucket", "_part")
    one = dealt.groupBy(*at).agg(F.min("text").alias("text"))
    terms = one.select(*at, F.explode_outer(bm25.terms(F.col("text"))).alias("term")).groupBy(*at, "term").agg(F.count("term").alias("tf"))
    forward = terms.groupBy(*at).agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("len"), F.filter(F.collect_list(F.struct("term", "tf")), lambda t: t["term"].isNotNull()).alias("terms"))
    _write(forward.drop("_bucket", "_part"), index, "forward", gen, dealt=True)
    forward = _read(spark, index, "forward", [gen])
    # ranges: classes of lengths, four for each doubling, split by hash into parts of about RANGE
    kind = F.floor(4 * F.log2(F.col("len") + 1)).cast("int")
    sizes = {r["kind"]: r["count"] for r in forward.groupBy(kind.alias("kind")).count().collect()} or {0: 1}  # some 200 classes at most
    parts = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, -(-n // RANGE))])
    span = F.xxhash64(F.lit(gen), kind, F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.element_at(parts, kind)))  # ranges that met by chance would only be bounded together
    # a document's terms of a group of buckets travel as one text (there are no spaces in them) to where the group's blocks of its range are made and written
    groups = min(GROUPS, index.buckets)
    terms = F.transform("terms", lambda t: F.struct((_bucket(t["term"], index) % groups).alias("group"), t["term"].alias("term"), t["tf"].cast("int").alias("tf")))
    rows = forward.select(span.alias("span"), "doc_id", "len", terms.alias("terms")).withColumn("_group", F.explode(F.array_distinct("terms.group")))
    own = rows.select("_group", part("span", groups).alias("_part"), "span", "doc_id", "len", F.filter("terms", lambda t: t["group"] == F.col("_group")).alias("t"))
    sent = own.select("_group", "_part", "span", "doc_id", "len", F.array_join("t.term", " ").alias("term"), F.col("t.tf").alias("tf")).repartition("_group", "_part")
    sent = sent.select("_group", "_part", "span", "doc_id", "len", F.explode(F.arrays_zip(F.split("term", " ").alias("term"), "tf")).alias("t")).select("_group", "_part", "span", "doc_id", "len", "t.term", F.col("t.tf").cast("long").alias("tf"))
    blocks = sent.groupBy("_group", "_part", "term", "span").agg(F.max("tf").alias("max_tf"), F.min("len").alias("min_len"), F.sort_array(F.collect_list(F.struct("doc_id", "tf", "len"))).alias("postings"))
    _write(blocks.drop("_group", "_part"), index, "blocks", gen, dealt=True)
    entries = forward.select(F.explode("terms").alias("t")).select("t.term", "t.tf")
    _write(entries.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")), index, "terms", gen)
    _write(forward.agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("total")), index, "stats", gen)
    _finish(spark, index, gen)


def _alive(rows, removed):
    """Rows whose document wasn't removed by a later generation."""
    if removed is None:
        return rows
    last = removed.groupBy("doc_id").agg(F.max("gen").alias("gone"))
    return rows.join(last, "doc_id", "left").where("gone is null or gone < gen").drop("gone")


def _removed(spark, index, gens=None):
    try:
        return _read(spark, index, "removed", gens)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None


def remove(ids, path):
    """Removes the documents of ``ids(doc_id)``: their terms are taken off the statistics, their postings are passed over by searches. Ids that aren't there change nothing."""
    spark = ids.sparkSession
    index = opened(spark, path)
    if index is None:
        return
    gen = _next(index)
    there = lambda which: _alive(_read(spark, index, "forward").where(F.col("bucket").isin(asked_for)).join(which, "doc_id", "left_semi"), _removed(spark, index))
    wanted = cut(ids.where("doc_id is not null").select(F.col("doc_id").cast(index.id_type)).distinct())
    asked_for = [r[0] for r in wanted.select(_bucket("doc_id", index)).distinct().collect()] or [-1]  # as many as buckets at most
    _write(there(wanted).select("doc_id"), index, "removed", gen)
    gone = there(_removed(spark, index, [gen]).select("doc_id"))
    counts = gone.select(F.explode("terms").alias("t")).groupBy("t.term").agg((-F.count("*")).alias("df"), (-F.sum("t.tf")).alias("cf"))
    _write(counts, index, "terms", gen)
    _write(gone.agg((-F.count("*")).alias("n"), (-F.coalesce(F.sum("len"), F.lit(0))).alias("total")), index, "stats", gen)
    _finish(spark, index, gen)


def search(queries, path, k=10, k1=1.5, b=0.75, df_mode="document"):
    """Best ``k`` documents of ``queries(query_id, text)``: query_id, doc_id, score, rank as ``bm25.search`` gives them, with blocks_read and blocks_there of the query."""
    spark = queries.sparkSession
    index = opened(spark, path)
    if index is None:
        raise ValueError(f"no index at {path}")
    asked = queries.select("query_id", F.explode(bm25.terms(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    asked_for = [r[0] for r in asked.select(_bucket("term", index)).distinct().collect()] or [-1]  # as many as buckets at most
    within = lambda name: _read(spark, index, name).where(F.col("bucket").isin(asked_for))
    stats = _read(spark, index, "stats").agg(F.sum("n").alias("n_docs"), F.try_divide(F.sum("total"), F.sum("n")).alias("avg_len"))
    counts = within("terms").join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("cf" if df_mode == "collection" else "df").alias("df")).where("df > 0")
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weights = asked.join(counts, "term").crossJoin(F.broadcast(stats)).select("query_id", "term", (F.col("qtf") * idf).alias("weight"), "avg_len")  # stats: one row
    part = lambda tf, size: F.col(tf) * (k1 + 1) / (F.col(tf) + k1 * (1 - b + b * F.col(size) / F.col("avg_len")))
    heads = within("blocks").select("term", "span", "max_tf", "min_len").join(weights, "term")
    bounds = heads.groupBy("query_id", "span").agg(F.sum(F.greatest(F.lit(0.0), F.col("weight") * part("max_tf", "min_len"))).alias("bound"), F.count("*").alias("blocks"))
    bounds = cut(bounds)
    removed = _removed(spark, index)

    def scored(chosen):
        need = chosen.select("query_id", "span").join(weights, "query_id")
        blocks = within("blocks").join(need.select("term", "span").distinct(), ["term", "span"], "left_semi")
        entries = blocks.select("gen", "term", "span", F.explode("postings").alias("p")).select("gen", "term", "span", "p.doc_id", "p.tf", "p.len")
        hits = _alive(entries, removed).join(need, ["term", "span"])
        return hits.groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("weight") * part("tf", "len")), 6).alias("score"))

    best = W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    promising = W.partitionBy("query_id").orderBy(F.desc("bound"), "span")
    first = bounds.withColumn("at", F.row_number().over(promising)).where(F.col("at") <= max(k, FIRST))
    first = cut(first.select("query_id", "span", "blocks"))
    early = cut(scored(first).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k))
    least = early.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("least"))
    rest = bounds.join(first.select("query_id", "span"), ["query_id", "span"], "left_anti").join(least, "query_id", "left").where("least is null or bound >= least - 1e-6")
    read = first.select("query_id", "blocks").union(rest.select("query_id", "blocks")).groupBy("query_id").agg(F.sum("blocks").alias("blocks_read"))
    there = bounds.groupBy("query_id").agg(F.sum("blocks").alias("blocks_there"))
    found = early.drop("rank").union(scored(rest)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.join(read, "query_id").join(there, "query_id")
