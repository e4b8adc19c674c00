"""BM25 over a document table: postings, statistics, ranked search."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F


def terms(text):
    """Lower-cased runs of non-space characters; punctuation stays."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != "")


def postings(docs, doc_id="doc_id", text="text"):
    """term, doc_id, tf. One map-side combined shuffle on (term, doc_id)."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.explode(terms(F.col(text))).alias("term")).groupBy("term", "doc_id").agg(F.count("*").alias("tf"))


def lengths(docs, doc_id="doc_id", text="text"):
    return docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.size(terms(F.col(text))), F.lit(0)).cast("long").alias("len"))


def search(docs, queries, k=10, k1=1.5, b=0.75, df_mode="collection", vocabulary=None):
    """Best ``k`` documents of ``queries(query_id, text)``: query_id, doc_id, score, rank; ties by doc_id.

    ``df`` of a term is its number of occurrences ("collection") or of documents ("document"). Repeated
    query terms count repeatedly. Only documents' terms that occur in a query are counted: the query
    terms are joined before the aggregation, so the shuffle holds matches, not all tokens. With ``vocabulary(term, stem)``
    terms of one stem count as one.
    """
    asked = queries.select("query_id", F.explode(terms(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    tokens = docs.select("doc_id", F.explode(terms(F.col("text"))).alias("term"))
    if vocabulary is None:
        tokens = tokens.join(asked.select("term").distinct(), "term", "left_semi")
    else:
        asked = asked.join(vocabulary, "term").groupBy("query_id", F.col("stem").alias("term")).agg(F.sum("qtf").alias("qtf"))
        wanted = vocabulary.join(asked.select(F.col("term").alias("stem")).distinct(), "stem", "left_semi")
        tokens = tokens.join(wanted, "term").select("doc_id", F.col("stem").alias("term"))
    tf = tokens.groupBy("term", "doc_id").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg((F.sum("tf") if df_mode == "collection" else F.count("*")).alias("df"))
    size = lengths(docs)
    stats = size.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    hits = tf.join(df, "term").join(size, "doc_id").join(asked, "term").crossJoin(F.broadcast(stats))  # stats: one row
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    scored = hits.groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("qtf") * idf * part), 6).alias("score"))
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def remove(docs, removed):
    """Documents less those of ``removed(doc_id)``; postings and statistics follow from what is left."""
    return docs.join(removed.select("doc_id").distinct(), "doc_id", "left_anti")
