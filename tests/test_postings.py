"""The stored index against the plain search."""

import random

import pytest
from pyspark.sql import functions as F

from loomwork.operators import bm25, postings


def texts(n, seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(600)]
    return [(i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(600)], k=rng.choice([3, 8, 8, 40, 200])))) for i in range(n)]


SCHEMA = "doc_id long, text string"
QUERIES = [(1, "w150 w3"), (2, "w0 w1"), (3, "w199 w199 w7 none"), (4, ""), (5, None), (6, "nothing"), (7, "W42 w42")]


@pytest.fixture
def asked(spark):
    return spark.createDataFrame(QUERIES, "query_id long, text string")


def ranks(df):
    return sorted(tuple(r[c] for c in ("query_id", "rank", "doc_id", "score")) for r in df.collect())


@pytest.fixture(autouse=True)
def small_ranges(monkeypatch):
    monkeypatch.setattr(postings, "RANGE", 20)


@pytest.mark.parametrize("mode", ["document", "collection"])
def test_same_ranks_and_fewer_blocks(spark, asked, tmp_path, mode):
    d = spark.createDataFrame([*texts(1500, 1), (9001, None), (9002, " "), (None, "w1 w2"), (5, "w150 w150 w3")], SCHEMA).withColumn("term", F.lit(1)).withColumn("len", F.lit("x"))
    postings.add(d, str(tmp_path), buckets=4)
    plain = d.where("doc_id is not null").groupBy("doc_id").agg(F.min("text").alias("text"))
    got = postings.search(asked, str(tmp_path), k=5, df_mode=mode).cache()
    assert ranks(got) == ranks(bm25.search(plain, asked, k=5, df_mode=mode)) and got.count() == 4 * 5
    counts = {r["query_id"]: (r["blocks_read"], r["blocks_there"]) for r in got.collect()}
    assert all(a <= b for a, b in counts.values()) and min(a / b for a, b in counts.values()) < 0.5 and sum(a for a, _ in counts.values()) < 0.8 * sum(b for _, b in counts.values()), counts


def test_deltas(spark, asked, tmp_path):
    path, first, more = str(tmp_path), texts(300, 2), texts(400, 3)
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    ids = lambda *rows: spark.createDataFrame([(i,) for i in rows], "doc_id long")
    postings.remove(ids(1), path)  # no index yet
    with pytest.raises(ValueError, match="no index"):
        postings.search(asked, path)
    postings.add(frame(first), path, buckets=4)
    postings.add(frame(more[250:]), path)  # 250 to 299 are replaced
    postings.remove(ids(*range(0, 400, 3), 12345, None), path)
    postings.add(frame(more[:10]), path)  # 0, 3, 6, 9 come back
    postings.remove(ids(3, 3), path)
    postings.remove(ids(3), path)
    there = {**dict(first), **dict(more[250:])}
    there = {i: t for i, t in there.items() if i % 3 or i < 0} | dict(more[:10])
    del there[3]
    assert ranks(postings.search(asked, path, k=7)) == ranks(bm25.search(frame(list(there.items())), asked, k=7, df_mode="document"))
    postings.remove(ids(*range(400)), path)
    assert postings.search(asked, path).count() == 0
    postings.add(frame([]), path)
    assert postings.search(asked, path).count() == 0


def test_broken_writes_and_versions(spark, asked, tmp_path, monkeypatch):
    path, rows = str(tmp_path), texts(100, 4)
    postings.add(spark.createDataFrame(rows[:50], SCHEMA), path, buckets=2)
    before = ranks(postings.search(asked, path))
    with monkeypatch.context() as m:
        m.setattr(postings, "_finish", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            postings.add(spark.createDataFrame(rows[50:], SCHEMA).where("doc_id > 70"), path)
    assert ranks(postings.search(asked, path)) == before
    postings.add(spark.createDataFrame(rows[50:60], SCHEMA), path)
    assert ranks(postings.search(asked, path)) == ranks(bm25.search(spark.createDataFrame(rows[:60], SCHEMA), asked, df_mode="document"))
    monkeypatch.setattr(postings, "VERSION", 2)
    with pytest.raises(ValueError, match="unsupported format version: 1"):
        postings.search(asked, path)
