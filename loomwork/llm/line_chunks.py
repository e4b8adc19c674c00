"""Operator 5: removal of repeated line chunks with content-defined boundaries (native).

A line ends at a newline, or at a blank after a word whose last character isn't one of the commonest last letters (so also
after commas and sentence ends) or before a word with certain first letters: some two to four words a line, and where depends on neighbouring characters alone. A hash rolls
over the hashes of two neighbouring lines; a chunk starts where it is a local minimum, which depends on four lines only and
so shifts with the text. A chunk is ``CHUNK`` lines long; chunks may overlap, and a passage needs one start with a chunk behind it. Of chunks whose hash occurs more than once, the later ones are compared byte by
byte with the first, stretch by stretch, and equal neighbouring lines are cut with them.
"""

import os
import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import _shared as S

#: What ends a line: one character, a newline, or a blank after a character that isn't a common last letter or before some letters.
UNCOMMON, BEGINS = "[^entrhdsailoyg]", "[bdklp]"
ENDS = rf"[\n ](?:(?<=\n)|(?<={UNCOMMON} )|(?={BEGINS}))"
AFTER_END = rf"(?<=[\n ])(?:(?<=\n)|(?<={UNCOMMON} )|(?={BEGINS}))"
CHUNK, CONTEXT = 6, 8  # CHUNK is even
#: Equal neighbouring lines count up to the last one of so many characters; shorter ones may be equal by chance.
LONG_LINE = 12
#: Chunk hashes seen in at least HOT_SEEN of the documents sampled (one in SAMPLE, by hash) are dealt by document, at most MAX_HOT of them.
SAMPLE, HOT_SEEN, MAX_HOT = 64, 24, 10_000


def _let(value, f):
    """``f(value)`` with ``value`` computed once a row, also inside lambdas."""
    return F.transform(F.array(value), f)[0]


def _lines(text):
    """Lines of a text without the characters that end them."""
    return F.split(text, ENDS)


def _rolled(h):
    """A hash over each line and the next one; ``h``: line hashes."""
    return F.transform(h, lambda x, i: F.shiftleft(x, 1).bitwiseXOR(F.get(h, i + 1)))


def _starts(r):
    """Places of the lines at which chunks start that fit in the text; ``r``: rolled hashes."""
    least = lambda i: (F.get(r, i) < F.get(r, i - 1)) & (F.get(r, i) <= F.get(r, i + 1))
    places = F.when(F.size(r) >= CHUNK, F.sequence(F.lit(0), F.size(r) - CHUNK)).otherwise(F.array().cast("array<int>"))
    return F.filter(places, lambda i: (i == 0) | least(i))


def _chunks(text):
    """Structs s, ch: the first line and the hash of each chunk in the text, over the rolled hashes of its pairs of lines."""
    hashes = F.transform(_lines(text), lambda x: F.xxhash64(x))
    chunk = lambda r, s: F.struct(s.alias("s"), F.xxhash64(*[F.get(r, s + m) for m in range(0, CHUNK, 2)]).alias("ch"))
    return _let(_let(hashes, _rolled), lambda r: F.transform(_starts(r), lambda s: chunk(r, s)))


def _twins(texts, folder):
    """doc_id, r, s, first_id, first_r, first_s: the later occurrences of repeated chunks and the first one of each, by doc_id, r and place.

    Chunks that a sample of documents shows often are known to be repeated; they are dealt by document, and only their first
    places are aggregated. So no chunk's occurrences meet in one task. Rows are written below ``folder``.
    """
    spark = texts.sparkSession
    some = texts.where(F.pmod(F.xxhash64(F.lit(SAMPLE), "doc_id", "r"), F.lit(SAMPLE)) == 0)
    often = some.select(F.explode(F.array_distinct(_chunks(F.col("text"))["ch"])).alias("ch")).groupBy("ch").count().where(F.col("count") >= HOT_SEEN)
    often = often.orderBy(F.desc("count"), "ch").limit(MAX_HOT).select("ch", F.lit(True).alias("hot"))
    rows = texts.select("doc_id", "r", F.explode(_chunks(F.col("text"))).alias("c"))
    # r and the chunk's line in one number
    rows = rows.select("doc_id", F.shiftleft(F.col("r").cast("long"), 32).bitwiseOR(F.col("c.s").cast("long")).alias("rs"), F.col("c.ch").alias("ch"))
    rows = rows.join(F.broadcast(often), "ch", "left").withColumn("salt", F.when(F.col("hot"), F.xxhash64("doc_id", "rs")))
    place = F.struct("doc_id", "rs")
    first = F.first(place).over(W.partitionBy("ch", "salt").orderBy("doc_id", "rs").rowsBetween(W.unboundedPreceding, W.currentRow))
    rows = rows.withColumn("first", first).where(F.col("hot") | (F.col("first") != place))
    rows.select("doc_id", "rs", F.when(F.col("hot"), F.col("ch")).alias("hot"), "first").write.parquet(folder)
    rows = spark.read.parquet(folder)
    top = rows.where("hot is not null").groupBy("hot").agg(F.min(place).alias("least"))  # at most MAX_HOT rows
    rows = rows.join(F.broadcast(top), "hot", "left").withColumn("first", F.coalesce("least", "first")).where(F.col("first") != place)
    r, s = lambda c: F.shiftright(c, 32).cast("int"), lambda c: F.col(c).bitwiseAND(F.lit(2**32 - 1)).cast("int")
    return rows.select("doc_id", r("rs").alias("r"), s("rs").alias("s"), F.col("first.doc_id").alias("first_id"), r("first.rs").alias("first_r"), s("first.rs").alias("first_s"))


def _stretches(twins):
    """By document (_at, _id, _r), an array of structs first_id, first_r, parts: by first document, the stretches delta, lo, hi of lines
    that later chunks span without a gap of more than CONTEXT lines."""
    pair = ["_at", "_id", "_r", "first_id", "first_r"]
    x = twins.select(F.xxhash64("doc_id", "r").alias("_at"), F.col("doc_id").alias("_id"), F.col("r").alias("_r"), "first_id", "first_r", (F.col("s") - F.col("first_s")).alias("delta"), "s").repartition("_at")
    order = W.partitionBy(*pair, "delta").orderBy("s")
    apart = F.coalesce(F.col("s") - F.lag("s").over(order) > CHUNK + CONTEXT, F.lit(False)).cast("int")
    x = x.withColumn("apart", apart).withColumn("part", F.sum("apart").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    x = x.groupBy(*pair, "delta", "part").agg(F.min("s").alias("lo"), (F.max("s") + CHUNK).alias("hi"))
    x = x.groupBy(*pair).agg(F.collect_list(F.struct("delta", "lo", "hi")).alias("parts"))
    return x.groupBy("_at", "_id", "_r").agg(F.collect_list(F.struct("first_id", "first_r", "parts")).alias("_stretches"))


def _with_lines(text, stretches):
    """The structs, each stretch with its lines, ``before`` lines ahead of them and CONTEXT following ones."""

    def one(lines, x):
        n = F.least(F.lit(CONTEXT), x["lo"], x["lo"] - x["delta"])
        return F.struct(x["delta"].alias("delta"), x["lo"].alias("lo"), x["hi"].alias("hi"), n.alias("before"), F.slice(lines, x["lo"] - n + 1, x["hi"] - x["lo"] + n + CONTEXT).alias("lines"))

    def of_first(lines, p):
        return F.struct(p["first_id"].alias("first_id"), p["first_r"].alias("first_r"), F.transform(p["parts"], lambda x: one(lines, x)).alias("parts"))

    return _let(_lines(text), lambda lines: F.transform(stretches, lambda p: of_first(lines, p)))


def _equal_lines(text, parts):
    """Places of the stretches' lines that are byte by byte those of ``text``, the first document's: all such lines of the
    chunks and between them, and those that adjoin on either side, up to the last long one."""

    def adjoining(flags, near):
        n = F.coalesce(F.nullif(F.array_position(flags, False), F.lit(0)) - 1, F.size(flags)).cast("int")
        return F.coalesce(F.array_max(F.transform(F.slice(near, 1, n), lambda x, i: F.when(F.length(x) >= LONG_LINE, i + 1))), F.lit(0))

    def places(x, ok):
        lo, hi, before = x["lo"], x["hi"], x["before"]
        head, tail = lambda a: F.reverse(F.slice(a, 1, before)), lambda a: F.slice(a, before + hi - lo + 1, CONTEXT)
        left, right = adjoining(head(ok), head(x["lines"])), adjoining(tail(ok), tail(x["lines"]))
        return F.filter(F.sequence(lo - left, hi + right - 1), lambda i: F.get(ok, i - lo + before))

    def part(lines, x):
        theirs = F.slice(lines, x["lo"] - x["before"] - x["delta"] + 1, F.size(x["lines"]))
        return _let(F.zip_with(x["lines"], theirs, lambda a, b: F.coalesce(a == b, F.lit(False))), lambda ok: places(x, ok))

    return _let(_lines(text), lambda lines: F.flatten(F.transform(parts, lambda x: part(lines, x))))


def drop_repeated_chunks(docs):
    """Documents with ``text`` less the repeated chunks, plus ``n_removed``, the number of lines cut.

    Of each chunk the first occurrence, by doc_id and then place, stays. All documents stay, some with
    empty text. Null and empty texts pass unchanged with 0 lines cut; rows alike in doc_id and text are one
    document (both stay, with the same text); null ids come first in order. Different texts of one doc_id are documents of their
    own: where the 32-bit hashes that order them are equal, lines are still compared with each text, and cut from the text compared. Texts of fewer than CHUNK lines hold no chunk, nor do texts
    without blanks and newlines. Other columns pass through; a column named ``n_removed`` is replaced. An empty table gives an empty result.
    """
    S.ensure_checkpoint_dir(docs.sparkSession)
    folder = os.path.join(docs.sparkSession.sparkContext.getCheckpointDir(), f"chunks-{uuid.uuid4().hex}")
    docs = docs.drop("n_removed")
    own = docs.columns
    # a document is found by doc_id and a short hash of its text, which _at deals; what is cut names the whole text by its digest
    by_doc = _stretches(_twins(docs.where("text <> ''").select("doc_id", "text", F.hash("text").alias("r")), folder))
    names = {c: f"own{k}" for k, c in enumerate(own)}  # so that no column's name clashes
    d = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], F.hash("text").alias("_r")).withColumn("_at", F.xxhash64(names["doc_id"], "_r")).alias("d")
    column = lambda c: F.col(f"d.{names[c]}")
    # whole rows are read each time, so that all joins share one exchange of the texts
    read = lambda n: F.size(F.array(F.xxhash64(*map(column, own)))) <= n

    def joined(other, when=None, how="inner", at="_at", id_="_id", r="_r"):
        other = other.alias("o")
        same = (F.col("d._at") == F.col(f"o.{at}")) & column("doc_id").eqNullSafe(F.col(f"o.{id_}")) & (F.col("d._r") == F.col(f"o.{r}"))
        return d.join(other, same if when is None else same & read(when), how)

    digest = F.unhex(F.md5(column("text").cast("binary")))
    later = joined(by_doc, F.size("o._stretches")).select("o._at", "o._id", "o._r", digest.alias("_digest"), F.explode(_with_lines(column("text"), F.col("o._stretches"))).alias("c"))
    later = later.select("_at", "_id", "_r", "_digest", "c.*").withColumn("first_at", F.xxhash64("first_id", "first_r"))
    both = joined(later, F.size("o.parts"), at="first_at", id_="first_id", r="first_r")
    cuts = both.select("o._at", "o._id", "o._r", "o._digest", _equal_lines(column("text"), F.col("o.parts")).alias("cut"))
    cuts = cuts.groupBy("_at", "_id", "_r").agg(F.collect_list(F.struct("_digest", "cut")).alias("_cuts"))
    of_text = _let(digest, lambda own_digest: F.array_distinct(F.flatten(F.transform(F.filter("o._cuts", lambda x: x["_digest"] == own_digest), lambda x: x["cut"]))))
    result = joined(cuts, how="left").withColumn("_cut", F.when(F.col("o._cuts").isNotNull(), of_text))
    pieces = lambda p: F.transform(F.array_except(F.sequence(F.lit(0), F.size(p) - 1), F.col("_cut")), lambda i: F.get(p, i))
    left = F.array_join(_let(F.split(column("text"), AFTER_END), pieces), "")
    text = F.when(F.col("_cut").isNull(), column("text")).otherwise(left)
    return result.select(*[(text if c == "text" else column(c)).alias(c) for c in own], F.coalesce(F.size("_cut"), F.lit(0)).alias("n_removed"))


def op5_line_chunks(spark, sf_dir):
    docs = S.table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_repeated_chunks(docs)


QUERIES = {"op5_line_chunks": op5_line_chunks}
