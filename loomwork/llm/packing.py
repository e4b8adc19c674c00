"""Operator 3: packing into optimal length buckets and token-budget batches.

Documents are cut into pieces of at most ``max_len`` tokens. Dynamic programming over the global histogram of
piece lengths chooses the bucket boundaries with the least padding; within a bucket, as many pieces go to a
batch as the token budget holds at the bucket's length. Tokens are words.
"""

import numpy as np
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import _shared as S


def boundaries(lengths, counts, n_buckets):
    """Bucket boundaries, a subset of ``lengths`` (ascending, the last one included), with the least padding.

    With at most ``n_buckets`` buckets; padding is the sum of (boundary - length) * count. best[j] after b rounds is
    the least cost of the first j lengths in b buckets; the best split point never moves left as j grows,
    so a round is solved by halving. Ties take the smaller split point.
    """
    x, c = np.asarray(lengths, float), np.asarray(counts, float)
    n = len(x)
    if n == 0:
        return []
    rows, words = np.r_[0, np.cumsum(c)], np.r_[0, np.cumsum(c * x)]

    def cost(i, j):  # lengths i..j-1 in one bucket
        return x[j - 1] * (rows[j] - rows[i]) - (words[j] - words[i])

    best, splits = np.r_[0, [cost(0, j) for j in range(1, n + 1)]], []
    for _ in range(1, min(n_buckets, n)):
        now, split, todo = best.copy(), np.zeros(n + 1, np.int64), [(1, n, 0, n)]
        while todo:
            lo, hi, left, right = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(left, min(j - 1, right) + 1)
            k = int(i[np.argmin(best[i] + cost(i, j))])
            now[j], split[j] = best[k] + cost(k, j), k
            todo += [(lo, j - 1, left, k), (j + 1, hi, k, right)]
        best = now
        splits.append(split)
    out, j = [], n
    for split in reversed(splits):
        out.append(int(x[j - 1]))
        j = int(split[j])
        if j == 0:
            break
    if j:
        out.append(int(x[j - 1]))
    return out[::-1]


def pack(docs, n_buckets=16, max_len=2048, budget=16_384, rows_per_shard=50_000, seed=3):
    """Pieces of all documents with bucket and batch.

    Returns doc_id, piece, first_token, n_tokens (of the piece), bucket_len (padded length), batch_id and slot.
    Lengths run up to ``max_len``, which bounds the histogram that the driver reads. A batch is numbered within its bucket
    and holds max(1, budget // bucket_len) pieces; only the last batch of a bucket may hold fewer. Pieces
    are numbered through in seeded order by counts per shard, so no task sorts a whole bucket.

    Null, empty and blank texts give one piece of 0 tokens with null bucket, batch and slot, so that no
    document is lost. Repeated rows are packed each; null ids too. Extra columns aren't read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    S.ensure_checkpoint_dir(spark)
    size = docs.select("doc_id", S.n_words(F.col("text")).alias("size"))
    cut = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.ceil(F.col("size") / max_len) - 1))
    pieces = size.select("doc_id", "size", F.explode(cut).alias("piece"))
    first = F.col("piece") * max_len
    pieces = pieces.select("doc_id", "piece", first.alias("first_token"), F.least(F.lit(max_len).cast("long"), F.col("size") - first).alias("n_tokens")).checkpoint()
    histogram = pieces.where("n_tokens > 0").groupBy("n_tokens").count().orderBy("n_tokens").collect()  # at most max_len rows
    edges = boundaries([r[0] for r in histogram], [r[1] for r in histogram], n_buckets)
    edges = edges or [max_len]
    total = sum(r[1] for r in histogram)
    bucket = F.element_at(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e >= F.col("n_tokens")), 1)
    n_shards = max(1, -(-total // rows_per_shard))
    full = pieces.where("n_tokens > 0").withColumn("bucket_len", bucket)
    full = full.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "piece"), F.lit(n_shards)))
    # a row per bucket and shard
    before = W.partitionBy("bucket_len").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    offsets = full.groupBy("bucket_len", "shard").count().select("bucket_len", "shard", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    order = W.partitionBy("bucket_len", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", "piece"), "doc_id", "piece", "n_tokens")
    placed = full.join(offsets, ["bucket_len", "shard"]).withColumn("at", F.col("offset") + F.row_number().over(order) - 1)
    holds = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket_len")))
    placed = placed.select("doc_id", "piece", "first_token", "n_tokens", "bucket_len", F.floor(F.col("at") / holds).alias("batch_id"), (F.col("at") % holds).cast("int").alias("slot"))
    none = pieces.where("n_tokens = 0").selectExpr("doc_id", "piece", "first_token", "n_tokens", "cast(null as int) bucket_len", "cast(null as long) batch_id", "cast(null as int) slot")
    return placed.unionByName(none)


def op3_packing(spark, sf_dir):
    return pack(S.table(spark, sf_dir, "documents"))


QUERIES = {"op3_packing": op3_packing}
