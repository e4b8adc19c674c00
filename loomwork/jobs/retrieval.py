"""Retrieval queries (R, O08): BM25, cosine, ranking."""

import uuid

import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.functions import align, stem
from loomwork.functions.fuzzy import fuzzy_score
from loomwork.jobs import code
from loomwork.operators import bm25, order, postings, vectors
from loomwork.operators.lineage import checkpoint_dir, cut
from loomwork.sources.tables import table

TOKENS_SQL = "tok AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS term FROM documents)"


def _docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


def _asked(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _bm25_sql(docs, k, df, asked="SELECT item_id AS query_id, text FROM benchmark"):
    return f"""WITH d AS ({docs}), tok AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS term FROM d),
    q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS term FROM ({asked})) GROUP BY ALL),
    tf AS (SELECT term, doc_id, count(*) AS tf FROM tok WHERE term IN (SELECT term FROM q) GROUP BY ALL), df AS (SELECT term, {df} AS df FROM tf GROUP BY term),
    len AS (SELECT d.doc_id, count(t.term) AS len FROM d LEFT JOIN tok t USING (doc_id) GROUP BY 1), st AS (SELECT count(*) AS n, avg(len) AS avg_len FROM len),
    sc AS (SELECT query_id, tf.doc_id, round(sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))), 6) AS score
      FROM tf JOIN df USING (term) JOIN len USING (doc_id) JOIN q USING (term), st GROUP BY ALL)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc) WHERE rank <= {k}"""


def r01_tokenize(spark, sf):
    return _docs(spark, sf).select(F.explode(bm25.terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("cf"))


def r02_bm25_postings(spark, sf):
    return bm25.postings(_docs(spark, sf))


def r03_bm25_search(spark, sf):
    return bm25.search(_docs(spark, sf), _asked(spark, sf))


def r04_bm25_remove(spark, sf):
    docs = _docs(spark, sf)
    return bm25.search(bm25.remove(docs, table(spark, sf, "labels").where("toxic = 1")), _asked(spark, sf), k=5, df_mode="document")


def _index(spark):
    """A new folder for an index, shared by all executors."""
    return f"{checkpoint_dir(spark)}/postings-{uuid.uuid4().hex}"


def s06_index_search(spark, sf):
    """The documents stored as an index, then searched: ranks as in r03, with document frequencies."""
    path = _index(spark)
    postings.add(_docs(spark, sf), path, buckets=8)
    return postings.search(_asked(spark, sf), path).drop("blocks_read", "blocks_there")


def s06_index_delta(spark, sf):
    """An index that is built of four fifths of the documents, gets the rest and some of the first again, and loses the toxic ones."""
    path, docs, k = _index(spark), _docs(spark, sf), F.col("doc_id")
    postings.add(docs.where(k % 5 != 0).withColumn("text", F.when(k % 50 == 1, F.lit("of no account")).otherwise(F.col("text"))), path, buckets=8)
    postings.add(docs.where((k % 5 == 0) | (k % 50 == 1)), path)
    postings.remove(table(spark, sf, "labels").where("toxic = 1"), path)
    return postings.search(_asked(spark, sf), path, k=5).drop("blocks_read", "blocks_there")


def r03_code_search(spark, sf):
    """A stored index over code elements (name, code and docstring), asked for the docstring of each kind of part."""
    path = _index(spark)
    postings.add(code.element_texts(spark, sf), path, buckets=8)
    asked = table(spark, sf, "part").select(F.col("p_type").alias("query_id"), F.concat(F.lit('def """Helper of '), "p_type", F.lit('."""')).alias("text")).distinct()
    return postings.search(asked, path).drop("blocks_read", "blocks_there")


STOP_WORDS = """
    a about above after again against all am an and any are aren't as at be because been before being below between both but by can can't cannot could
    couldn't did didn't do does doesn't doing don don't down during each few for from further had hadn't has hasn't have haven't having he he'd he'll he's
    her here here's hers herself him himself his how how's i i'd i'll i'm i've if in into is isn't it it's its itself just let's me more most mustn't my
    myself no nor not now of off on once only or other ought our ours ourselves out over own s same shan't she she'd she'll she's should shouldn't so some
    such t than that that's the their theirs them themselves then there there's these they they'd they'll they're they've this those through to too under
    until up very was wasn't we we'd we'll we're we've were weren't what what's when when's where where's which while who who's whom why why's will with
    won't would wouldn't you you'd you'll you're you've your yours yourself yourselves
"""


def _knn(spark, sf, **kw):
    v = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return vectors.knn(v, v.where("vec_id % 20 = 0"), **kw)


def r05_cosine_knn(spark, sf):
    return _knn(spark, sf, k=5)


def r06_cosine_knn_positive(spark, sf):
    return _knn(spark, sf, k=3, min_score=0.0)


def _cosine_sql(k, least):
    return f"""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS x FROM embeddings WHERE vec_id % 20 = 0),
    s AS (SELECT query_id, vec_id, round(list_cosine_similarity(x, embedding::DOUBLE[]), 6) AS score FROM q, embeddings)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s WHERE score >= {least}) WHERE rank <= {k}"""


def stop_words():
    """English stop words as Spark's own remover has them; written down, so that neither a session nor Spark's jars beside the package are needed."""
    return STOP_WORDS.split()


def r07_tool_search(spark, sf):
    """Search by stems without English stop words, best 8, document frequencies. Each distinct term is stemmed once."""
    stop = F.array(*[F.lit(w) for w in stop_words()])
    plain = lambda df: df.withColumn("text", F.array_join(F.filter(bm25.terms(F.col("text")), lambda t: ~F.array_contains(stop, t)), " "))
    docs, asked = plain(_docs(spark, sf)), plain(_asked(spark, sf))
    terms = docs.select("text").union(asked.select("text")).select(F.explode(bm25.terms(F.col("text"))).alias("term")).distinct()
    return bm25.search(docs, asked, k=8, df_mode="document", vocabulary=cut(stem.stems(terms)))


@F.pandas_udf(T.IntegerType())
def _fuzzy(text: pd.Series, needle: pd.Series) -> pd.Series:
    return pd.Series([fuzzy_score(t, n) for t, n in zip(text, needle, strict=True)], dtype="Int32")


def r10_fuzzy_match(spark, sf):
    """Subsequence scores of addresses for short needles, the beginnings of nation names; smaller is better."""
    needles = table(spark, sf, "nation").select(F.lower(F.substring("n_name", 1, 3)).alias("needle")).distinct()
    urls = table(spark, sf, "pages").select("page_id", "url")
    return urls.join(F.broadcast(needles)).select("page_id", "needle", _fuzzy("url", "needle").alias("score")).where("score is not null")


def r08_fuzzy_search(spark, sf):
    """Best 5 addresses for each part's last word, by alignment, and how many match; ties by address."""
    needles = table(spark, sf, "part").select(F.substring(F.substring_index("p_name", " ", -1), 1, 4).alias("needle")).union(table(spark, sf, "nation").select(F.lower(F.substring("n_name", 1, 3)))).distinct()
    found = align.matches(table(spark, sf, "pages").select("page_id", "url"), needles, "url")
    best = W.partitionBy("needle").orderBy(F.desc("score"), "url", "page_id")
    top = found.withColumn("rank", F.row_number().over(best)).where("rank <= 5")
    return top.join(found.groupBy("needle").agg(F.count("*").alias("matches")), "needle").select("needle", "page_id", "url", "score", "matches", "rank")


def r09_score_order(spark, sf):
    """All rows in order of score, descending, then path: the ordinal of each page by length of its text."""
    return order.ranked(table(spark, sf, "pages").select("page_id", "url", F.length("html").alias("score")), F.desc("score"), "url", "page_id")


QUERIES = {f.__name__: f for f in (r01_tokenize, r02_bm25_postings, r03_bm25_search, r04_bm25_remove, r05_cosine_knn, r06_cosine_knn_positive, r07_tool_search, r08_fuzzy_search, r09_score_order, r10_fuzzy_match, s06_index_search, s06_index_delta, r03_code_search)}
ORACLES = {
    "r01_tokenize": f"WITH {TOKENS_SQL} SELECT term, count(*) AS cf FROM tok GROUP BY 1",
    "r02_bm25_postings": f"WITH {TOKENS_SQL} SELECT term, doc_id, count(*) AS tf FROM tok GROUP BY 1, 2",
    "r03_bm25_search": _bm25_sql("SELECT doc_id, text FROM documents", 10, "sum(tf)"),
    "r04_bm25_remove": _bm25_sql("SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)", 5, "count(*)"),
    "s06_index_search": _bm25_sql("SELECT doc_id, text FROM documents", 10, "count(*)"),
    "s06_index_delta": _bm25_sql("SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)", 5, "count(*)"),
    "r03_code_search": _bm25_sql(code.TEXTS_SQL, 10, "count(*)", "SELECT DISTINCT p_type AS query_id, 'def \"\"\"Helper of ' || p_type || '.\"\"\"' AS text FROM part"),
    "r07_tool_search": f"""WITH raw AS (SELECT false AS asks, doc_id AS id, text FROM documents UNION ALL SELECT true, item_id, text FROM benchmark),
      t AS (SELECT asks, id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS term FROM raw), kept AS (SELECT * FROM t WHERE term NOT IN ({', '.join("'" + w.replace("'", "''") + "'" for w in stop_words())})),
      words AS (SELECT DISTINCT term FROM kept), st AS ({stem.stems_sql("words")}), s AS (SELECT asks, id, stem FROM kept JOIN st USING (term)),
      q AS (SELECT id AS query_id, stem, count(*) AS qtf FROM s WHERE asks GROUP BY ALL), tf AS (SELECT stem, id AS doc_id, count(*) AS tf FROM s WHERE NOT asks AND stem IN (SELECT stem FROM q) GROUP BY ALL),
      df AS (SELECT stem, count(*) AS df FROM tf GROUP BY 1), len AS (SELECT d.doc_id, count(k.term) AS len FROM documents d LEFT JOIN kept k ON k.id = d.doc_id AND NOT k.asks GROUP BY 1), n AS (SELECT count(*) AS n, avg(len) AS avg_len FROM len),
      sc AS (SELECT query_id, tf.doc_id, round(sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))), 6) AS score FROM tf JOIN df USING (stem) JOIN len USING (doc_id) JOIN q USING (stem), n GROUP BY ALL)
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc) WHERE rank <= 8""",
    "r05_cosine_knn": _cosine_sql(5, -1),
    "r06_cosine_knn_positive": _cosine_sql(3, 0),
    "r09_score_order": "SELECT page_id, url, length(html) AS score, row_number() OVER (ORDER BY length(html) DESC, url, page_id) AS rank FROM pages",
}
