"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, for every operator."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomwork.llm import audio, flat_graph, language_id, line_chunks, lsh_forest, mixing, packing, pitman_yor, token_counts, toxicity

LONG = " ".join([*(f"w{i % 977}x{i % 13}" for i in range(30_000 - 1)), "q" * 20_000])
ROWS = [(1, "A b c d e f g", "en", "s1", 13), (1, "A b c d e f g", "en", "s1", 13), (2, None, None, None, None), (3, "", "de", "s1", 0), (4, " \t\n", "de", None, 3), (None, "x y z", None, "s2", 5), (5, LONG, "en", "s2", None), (6, "a B c D e f G", "fr", "s1", 13), (7, "über der straße", "de", "s1", 15)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASHES = ["_at", "_id", "_r", "_cut", "r", "s", "ch", "at", "lo", "hi", "parts", "first", "size", "n", "id", "kind", "block", "part", "tree", "row", "comp", "shard", "target", "taken", "copies", "bucket", "batch_id", "k", "h", "body", "starts", "chunks", "n_lines", "n_removed", "grade", "features", "_rid", "skey", "x", "score", "held_out"]


def words(text):
    return (text or "").encode().split()


OPERATORS = {
    "near_duplicates": lsh_forest.near_duplicates,
    "pack": packing.pack,
    "score_texts": pitman_yor.score_texts,
    "drop_repeated_chunks": line_chunks.drop_repeated_chunks,
    "identify": lambda d: language_id.identify(d, language_id.fit(d, rounds=1)),
    "token_counts": token_counts.token_counts,
    "mix": mixing.mix,
    "audio_columns": audio.audio_columns,
    "toxicity": lambda d: toxicity.score(d, toxicity.fit(d, d.sparkSession.createDataFrame([(1, 1), (5, 0), (None, 1), (6, None)], "doc_id long, toxic int"))),
}


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(ROWS, SCHEMA)
    return d.withColumns({c: F.lit(c) for c in CLASHES})


@pytest.mark.parametrize("name", OPERATORS)
def test_rows_and_repeats(docs, name):
    got = OPERATORS[name](docs).collect()
    ids = [r["doc_id"] for r in got if name != "pack" or r["piece"] == 0]
    assert sorted(ids, key=str) == sorted((r[0] for r in ROWS), key=str)
    twice = [r.asDict() for r in got if r["doc_id"] == 1]
    if name not in ("pack", "mix"):  # these number copies through
        assert twice[0] == twice[1]


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], SCHEMA)).count() == 0


def test_defined_results(docs):
    by = lambda df: {r["doc_id"]: r for r in df.collect()}
    near = by(lsh_forest.near_duplicates(docs))
    assert [near[i]["n_shingles"] for i in (2, 3, 4)] == [0, 0, 0] and near[6]["component_id"] == 1 and not near[6]["kept"]
    assert near[None]["component_id"] is None and near[None]["kept"] is False and near[4]["component_id"] == 4
    scored = by(pitman_yor.score_texts(docs))
    assert all(scored[r[0]]["n_tokens"] == len(words(r[1])) + 1 for r in ROWS)
    mixed = by(mixing.mix(docs))
    assert all(mixed[r[0]]["size"] == len(words(r[1])) and mixed[r[0]]["taken"] <= 2 * mixed[r[0]]["size"] for r in ROWS)
    assert {i: by(OPERATORS["identify"](docs))[i]["lang_pred"] for i in (2, 3, 4)} == {2: "und", 3: "und", 4: "und"}
    assert not language_id.words("² 12 _ --") and language_id.words("Aé1b") == ["▁aé", "▁b"]
    counts = by(token_counts.token_counts(docs))
    assert all(counts[r[0]]["n_pretokens"] == len(words(r[1])) for r in ROWS)
    pieces = [r for r in packing.pack(docs, max_len=1000).collect() if r["doc_id"] == 5]
    assert sorted((r["first_token"], r["n_tokens"]) for r in pieces) == [(k * 1000, 1000) for k in range(30)]
    assert line_chunks.drop_repeated_chunks(docs).columns == [c for c in docs.columns if c != "n_removed"] + ["n_removed"]
    sound = by(audio.audio_columns(docs))
    assert sound[2]["payload_bytes"] == sound[3]["payload_bytes"] == 192 and sound[2]["feature"] == sound[3]["feature"]


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [None, 1.0]), (None, [1.0, 0.0]), (7, [2.0, 0.0]), (7, [2.0, 0.0]), (8, [0.0, 1.0]), (9, [inf, 1.0]), (10, [1.0]), (11, [1.0, 0.0, 0.0])]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("x", "norm", "label", "component", "centre", "copies", "n_links")})
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in flat_graph.near_vectors(t).collect()}
    assert got == {1: (2, 1, True), 2: (2, 1, False), 3: (0, 3, True), 4: (0, 4, True), 5: (0, 5, True), 6: (0, 6, True), None: (0, None, False), 7: (2, 1, False), 8: (0, 8, True), 9: (0, 9, True), 10: (0, 10, True), 11: (0, 11, True)}
    assert flat_graph.near_vectors(t.limit(0)).count() == 0


@pytest.mark.parametrize("k", range(5))
def test_pipeline_stages(spark, docs, tmp_path, k):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 1), (None, None, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    name, stage = corpus_pipeline.STAGES[k]
    got = stage(spark, docs, str(tmp_path))
    assert got.count() > 0
    if k < 4:
        assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert stage(spark, spark.createDataFrame([], SCHEMA), str(tmp_path)).count() == 0


def test_toxicity_fits_repeated_rows_once(spark):
    """Rows that repeat a labelled document neither weigh more nor go beyond max_rows; different texts of one id count each."""
    rows = [(i, f"vile{i % 3} word{i} plain" if i % 4 == 0 else f"word{i} plain kind{i % 5}") for i in range(120)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(120)], "doc_id long, toxic int")
    once = spark.createDataFrame(rows, "doc_id long, text string")
    often = spark.createDataFrame(rows * 5, "doc_id long, text string")
    other = spark.createDataFrame([(0, f"text{k} plain") for k in range(200)], "doc_id long, text string")
    model, again = toxicity.fit(once, labels), toxicity.fit(often, labels)
    assert model.weights and model.weights == again.weights and list(model.thresholds) == list(again.thresholds)
    seen = []
    plain, toxicity.fit_rows = toxicity.fit_rows, lambda r, *a, **kw: seen.append(len(r)) or plain(r, *a, **kw)
    try:
        toxicity.fit(often.union(other), labels, max_rows=100, min_association=0.0)
    finally:
        toxicity.fit_rows = plain
    assert seen == [100]
