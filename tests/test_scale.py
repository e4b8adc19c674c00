"""Queries that failed on tables of 1 GB and more: what they keep off the driver, and their results against plain ones."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork import jobs
from loomwork.operators import graph, path_index, postings, vectors


def plan(df, capsys):
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def test_modules_are_dealt_to_tasks(spark, sf_dir, monkeypatch):
    """Modules cost far more than the table's file says, which one task used to read."""
    from loomwork.jobs import code, code_brace

    for module in (code, code_brace):
        monkeypatch.setattr(module, "PER_TASK", 32)
        assert module._files(spark, sf_dir).rdd.getNumPartitions() == math.ceil(200 / 32)


def test_calls_in_bands(spark, sf_dir):
    """The least key in a band of balances, against all pairs; with equal numbers, steps' ends, numbers that rounding moves, and ones that aren't finite."""
    rng = random.Random(6)
    odd = [0.0, -0.0, -1e-17, 500.0, 499.99999999999994, 1000.0, -500.0, 1e17, 1e17 + 16, 1e300, math.inf, -math.inf, math.nan, None]
    number = lambda: rng.choice([rng.choice(odd), rng.choice([-250.0, 0.1, 999.9]), round(rng.uniform(-1500, 3000), 2)])
    points = [(k, rng.choice([1, 2, None]), number()) for k in rng.sample(range(10_000), 400)]
    asks = [(k // 2, rng.choice([1, 2, 3, None]), number()) for k in range(600)]
    inside = lambda a, p: None not in (a, p) and a < p < a + 500
    want = {}
    for ask, name, at in asks:
        fit = [k for k, n, p in points if n is not None and n == name and inside(at, p)]
        if fit:
            want[ask] = min([*fit, *([want[ask]] if ask in want else [])])
    schema = "{} long, name int, at double"
    got = graph.least_in_band(spark.createDataFrame(asks, schema.format("ask")), spark.createDataFrame(points, schema.format("key")), 500)
    assert {r["ask"]: r["least"] for r in got.collect()} == want and len(want) > 50


def test_calls_meet_no_pairs(spark, sf_dir, tmp_path):
    """Rows joined grow with the tables, not with customers times suppliers of a nation."""
    for name, keys in (("customer", "c_custkey"), ("supplier", "s_suppkey")):
        t = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        t.crossJoin(spark.range(20).withColumnRenamed("id", "_i")).withColumn(keys, F.col(keys) + F.col("_i") * 1000).drop("_i").write.parquet(f"{tmp_path}/{name}.parquet")
    calls = jobs.queries()["j02_calls"](spark, str(tmp_path))
    c, s = (spark.read.parquet(f"{tmp_path}/{n}.parquet") for n in ("customer", "supplier"))
    rank = "case when s_acctbal > c_acctbal and s_acctbal < c_acctbal + 500 then 1 when s_suppkey % 5 = c_custkey % 5 then 2 else 3 end as priority"
    pairs = c.join(s, F.col("c_nationkey") == F.col("s_nationkey")).selectExpr("c_custkey", "s_suppkey", rank)
    want = graph.first_by(pairs, ["c_custkey"], "priority", "s_suppkey").where("s_suppkey <> c_custkey")
    assert sorted(map(tuple, calls.collect())) == sorted(map(tuple, want.select("c_custkey", "s_suppkey", "priority").collect()))
    assert "row_number" not in calls._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("blocks", [None, (64 * 8, 50 * 8, 1000)])
def test_knn_against_all_pairs(spark, capsys, monkeypatch, blocks):
    """Neighbours with many equal scores, copies and opposite vectors, in one block or many; queries aren't broadcast."""
    for name, n in zip(("QUERIES", "VECTORS", "SCORES"), blocks or (), strict=False):
        monkeypatch.setattr(vectors, name, n)
    rng = np.random.default_rng(3)
    x = rng.integers(-2, 3, (900, 8)).astype(float)
    x[rng.choice(900, 300, False)] = x[0]
    x[rng.choice(900, 100, False)] += rng.normal(size=(100, 8))
    ids = rng.permutation(900)
    v = spark.createDataFrame([(int(i), [float(c) for c in r]) for i, r in zip(ids, x, strict=True)] + [(1000, [math.nan] * 8), (1020, [math.inf] * 8), (1040, [1.0, None] * 4), (1060, []), (1080, [2.0])], "vec_id long, embedding array<double>").repartition(3)
    got = vectors.knn(v, v.where("vec_id % 20 = 0"), k=7, min_score=0.25)
    assert "CartesianProduct" in plan(got, capsys)
    norms, want = np.linalg.norm(x, axis=1), {(1080, 1, 1080, 1.0)}
    for i in np.flatnonzero((ids % 20 == 0) & (norms > 0)):
        s = np.round(np.divide(x @ x[i], norms * norms[i], out=np.zeros(900), where=norms > 0), 6)
        top = [j for j in np.lexsort((ids, -s))[:7] if s[j] >= 0.25]
        want |= {(int(ids[i]), r + 1, int(ids[j]), float(s[j])) for r, j in enumerate(top)}
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect()} == want


@pytest.mark.parametrize("name", ["j01_code_defines", "j02_code_calls", "j04_code_imports", "j07_code_inherits", "g01_code_callers", "x01_code_changes", "j02_brace_edges"])
def test_parsed_rows_are_not_broadcast(spark, sf_dir, capsys, name):
    """Spark takes rows parsed from a small table for few; they went to the driver whole."""
    assert "Broadcast" not in plan(jobs.queries()[name](spark, sf_dir), capsys)


def test_code_texts_are_not_broadcast(spark, sf_dir, capsys):
    from loomwork.jobs import code

    assert "Broadcast" not in plan(code.element_texts(spark, sf_dir), capsys)


def test_grams_are_not_broadcast(spark, capsys):
    frame = lambda *rows: spark.createDataFrame([(r,) for r in rows], "path string")
    got = path_index.pairs(frame("src/a.py", "src/b.py"), frame("a.p", "b", "zz").toDF("needle"))
    text = plan(got, capsys)
    assert text.count("SortMergeJoin") >= 2 and sorted(map(tuple, got.collect())) == [("a.p", "src/a.py"), ("b", "src/b.py")]


def test_index_is_written_with_one_shuffle_a_table(spark, capsys, monkeypatch, tmp_path):
    """Texts and postings were shuffled once to be grouped and again, as long as before, to be written by bucket."""
    seen, write = {}, postings._write

    def spy(df, index, name, gen, *more, **kw):
        def said(self, path, parquet=type(df.write).parquet):
            seen[name] = plan(self._df, capsys)
            parquet(self, path)

        with monkeypatch.context() as m:
            m.setattr(type(df.write), "parquet", said)
            write(df, index, name, gen, *more, **kw)

    monkeypatch.setattr(postings, "_write", spy)
    postings.add(spark.createDataFrame([(k, f"a b{k % 7} c{k}") for k in range(50)], "doc_id long, text string"), str(tmp_path), buckets=4)
    assert {n: seen[n].count("Exchange") for n in ("forward", "blocks")} == {"forward": 1, "blocks": 1}
