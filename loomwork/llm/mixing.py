"""Operator 9: mixing sources to target weights by Sainte-Lague apportionment (native).

Only DataFrame functions. Word counts are aggregated per (source, shard), so every window but the one
over sources works on a shard's rows of one source; a hot source is spread over all shards, whose number
follows the words there are.
"""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import _shared as S

#: Multipliers of the seeded permutation of a group's blocks; the second serves groups whose number of blocks the first divides.
PRIMES = (7368787, 1299709)


def _source_key(source):
    """Null-safe join key of a source."""
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source))


def source_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """Adds ``target`` to ``sizes(skey, source, source_size)``: ``share`` of all words, by weight, at most ``cap`` times a source.

    Sources by code point, null last, take the weights in turn. Water filling in closed form: in order of
    cap per weight, a source is filled to its cap while its cap per weight is at most the level that the
    rest would share. One row per source; ties are broken by source.
    """
    order = W.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("w", w).withColumn("room", cap * F.col("source_size"))
    by_ratio = W.orderBy(F.col("room") / F.col("w"), F.col("skey"))
    before, rest = by_ratio.rowsBetween(W.unboundedPreceding, -1), by_ratio.rowsBetween(0, W.unboundedFollowing)
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    total = share * F.sum("source_size").over(everything)
    level = (total - F.coalesce(F.sum("room").over(before), F.lit(0.0))) / F.sum("w").over(rest)
    leveled = ranked.withColumn("level", level)
    final = F.min(F.when(F.col("room") / F.col("w") > F.col("level"), F.struct(F.col("room") / F.col("w"), F.col("skey"), F.col("level")))).over(everything)["level"]
    return leveled.withColumn("final", final).select(
        "skey", "source", "source_size", F.coalesce(F.least("room", F.col("w") * F.col("final")), F.col("room")).cast("double").alias("target")
    )


def sainte_lague(rows, key, votes, seats, within=()):
    """Seats by highest quotients votes / (2k + 1): adds ``quota`` to ``rows``; ties go to the smaller ``key``.

    Quotients are only laid out near the divisor method's first guess: rounding shifts a party's count by
    at most its share of the number of parties, so rows made are a small multiple of the parties.
    ``seats`` is a column, equal within a group; groups without votes get 0.
    """
    group = W.partitionBy(*within) if within else W.partitionBy(F.lit(0))
    x = rows.withColumn("_all", F.sum(votes).over(group)).withColumn("_n", F.count(F.lit(1)).over(group)).withColumn("_seats", seats)
    x = x.withColumn("_share", F.when(F.col("_all") > 0, votes / F.col("_all")).otherwise(0.0))
    x = x.withColumn("_guess", F.round(F.col("_share") * F.col("_seats")).cast("long"))
    x = x.withColumn("_h", (F.ceil(F.col("_share") * F.col("_n")) + 2).cast("long"))
    x = x.withColumn("_lo", F.greatest(F.lit(0).cast("long"), F.col("_guess") - F.col("_h")))
    x = x.withColumn("_base", F.sum("_lo").over(group))
    laid = x.withColumn("_k", F.explode(F.sequence(F.col("_lo"), F.col("_guess") + F.col("_h"))))
    laid = laid.withColumn("_q", votes / (2 * F.col("_k") + 1))
    best = (W.partitionBy(*within) if within else W.partitionBy(F.lit(0))).orderBy(F.col("_q").desc(), F.col(key))
    laid = laid.withColumn("_won", (F.row_number().over(best) <= F.col("_seats") - F.col("_base")) & (F.col("_q") > 0))
    return laid.groupBy(*rows.columns).agg((F.min("_lo") + F.sum(F.col("_won").cast("long"))).alias("quota"))


def plan(docs, words_per_block=16, words_per_shard=2_000_000, weights=(3, 1, 2), share=1.5, cap=2.0, seed=9):
    """Quotas per source and shard; returns (documents with size, key and shard; quotas)."""
    sized = docs.withColumn("size", S.n_words(F.col("text"))).withColumn("skey", _source_key(F.col("source")))
    total = sized.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]  # one number
    shards = max(1, -(-total // words_per_shard))
    sized = sized.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(shards)))
    groups = sized.groupBy("skey", "source", "shard").agg(F.sum("size").alias("group_size"))
    sources = groups.groupBy("skey", "source").agg(F.sum("group_size").alias("source_size"))
    targets = source_targets(sources, weights, share, cap)
    whole = W.partitionBy(F.lit(0))
    blocks = F.round(F.sum("target").over(whole) / words_per_block)
    targets = sainte_lague(targets, "skey", F.col("target"), blocks).withColumnRenamed("quota", "source_quota")
    shares = groups.drop("source").join(targets, "skey")
    quotas = sainte_lague(shares, "shard", F.col("group_size"), F.col("source_quota"), within=("skey",))
    n = F.ceil(F.col("group_size") / words_per_block)
    return sized, quotas.select("skey", "shard", "source_size", "target", n.alias("n_blocks"), F.least("quota", (cap * n).cast("long")).alias("quota"))


def mix(docs, words_per_block=16, words_per_shard=2_000_000, weights=(3, 1, 2), share=1.5, cap=2.0, seed=9):
    """Adds ``size``, ``source_size``, ``target``, ``taken`` and ``copies`` (copies of each block) to every document.

    The documents of a source in a shard, in seeded order, form one stream of words that is cut into equal
    blocks. Sainte-Lague gives each source its number of blocks, then each of its shards; every block is
    taken quota // blocks times and a seeded permutation chooses those that are taken once more. ``taken``
    counts a document's words in the blocks taken, repeats included, and is at most cap times its size.
    ``first_word`` is the place of its first word in the stream.

    Null or empty texts have size 0 and take 0; a null source is a source of its own, last in order; null
    ids count as one id; repeated rows are separate documents, and equal in every result but which of them
    stands first. An empty table gives an empty result. Columns of the input that have these names are replaced.
    """
    own = ["size", "skey", "shard", "source_size", "target", "n_blocks", "quota", "first_word", "copies", "taken"]
    docs = docs.drop(*own)
    sized, quotas = plan(docs, words_per_block, words_per_shard, weights, share, cap, seed)
    x = sized.join(quotas, ["skey", "shard"])
    order = W.partitionBy("skey", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    x = x.withColumn("first_word", F.sum("size").over(order) - F.col("size"))
    a = F.when(F.col("n_blocks") % PRIMES[0] == 0, F.lit(PRIMES[1])).otherwise(F.lit(PRIMES[0])).cast("long")
    off = F.pmod(F.xxhash64(F.lit(seed + 2), "skey", "shard"), F.col("n_blocks"))
    first, last = F.floor(F.col("first_word") / words_per_block), F.floor((F.col("first_word") + F.col("size") - 1) / words_per_block)
    extra = lambda j: (F.pmod(j * a + off, F.col("n_blocks")) < F.col("quota") % F.col("n_blocks")).cast("long")
    copies = F.transform(F.sequence(first, last), lambda j: F.floor(F.col("quota") / F.col("n_blocks")) + extra(j))
    x = x.withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(F.array().cast("array<bigint>")))
    end = F.col("first_word") + F.col("size")

    def words(c, i):
        j = first + i
        return c * (F.least(end, (j + 1) * words_per_block) - F.greatest(F.col("first_word"), j * words_per_block))

    taken = F.aggregate(F.transform("copies", words), F.lit(0).cast("long"), lambda s, v: s + v)
    return x.withColumn("taken", taken.cast("long")).select(*docs.columns, "size", "source_size", "target", "taken", "first_word", "copies")


def take(docs, words_per_block=16, **kw):
    """The mix as documents: one row per document and repeat that keeps any block, the text cut to the words taken.

    White space after a word stays with it; a text that is taken whole stays as it is. ``n_chars`` is renewed.
    Documents of which nothing is taken, those without words among them, have no row.
    """
    x = mix(docs, words_per_block, **kw).where("taken > 0")
    x = x.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), F.array_max("copies"))))
    whole = F.forall("copies", lambda c: c >= F.col("_k"))
    words = F.regexp_extract_all(F.col("text"), F.lit(S.WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    at = lambda i: (F.floor((F.col("first_word") + i) / words_per_block) - F.floor(F.col("first_word") / words_per_block)).cast("int")
    kept = F.array_join(F.filter(words, lambda w, i: F.get("copies", at(i)) >= F.col("_k")), "")
    out = x.withColumn("text", F.when(whole, F.col("text")).otherwise(kept))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op9_mixing(spark, sf_dir):
    docs = S.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op9_mixing": op9_mixing}
