"""Blocks of text by indentation."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwork.functions import text as tx

#: How a comment line begins, and the width of a level.
COMMENTS = ("#", "//", "--")
LEVEL = 4


def indented_block(texts, key, text, anchor, levels, siblings, header, most):
    """Lines (key, line "L<n>: ...") around line ``anchor`` (from 1) of each text, by columns of ``texts``.

    Blank lines take over the indent above them. The block goes up and down while lines are as deep as the anchor less ``levels``
    levels (0: any depth). Without ``siblings`` it takes one line of that least depth in each direction and ends before the second; upwards
    comments may follow with ``header``. At most ``most`` lines are taken, in turn above and below; blank lines at the ends go.
    Lines are cut to 500 bytes. Null texts and anchors out of range give no rows. A text's lines are one group, so
    its length bounds the window; ``key`` must be unique.
    """
    x = texts.select(key, *[F.col(c).alias(f"_{c}") for c in (anchor, levels, siblings, header, most)], F.posexplode(F.split(text, "\r?\n")).alias("_n", "_line"), F.size(F.split(text, "\r?\n")).alias("_size"))
    x = x.where("not (_n = _size - 1 and _line = '')").withColumn("_n", F.col("_n") + 1)  # what follows the last line end is no line
    top = W.partitionBy(key).orderBy("_n")
    own = F.when(F.trim(F.replace("_line", F.lit("\t"), F.lit(" "))) != "", tx.indent(F.col("_line")))
    x = x.withColumn("_indent", F.coalesce(F.last(own, ignorenulls=True).over(top), F.lit(0)))
    x = x.withColumn("_at", F.max(F.when(F.col("_n") == F.col(f"_{anchor}"), F.col("_indent"))).over(W.partitionBy(key))).where("_at is not null")
    x = x.withColumn("_least", F.when(F.col(f"_{levels}") == 0, 0).otherwise(F.greatest(F.lit(0), F.col("_at") - LEVEL * F.col(f"_{levels}"))))
    x = x.withColumn("_far", F.abs(F.col("_n") - F.col(f"_{anchor}"))).withColumn("_up", F.col("_n") < F.col(f"_{anchor}"))
    side = W.partitionBy(key, "_up").orderBy("_far")
    nearer = F.count_if((F.col("_indent") == F.col("_least")) & (F.col("_far") > 0)).over(side.rowsBetween(W.unboundedPreceding, -1))
    comment = F.lit(False)
    for c in COMMENTS:
        comment |= F.ltrim("_line").startswith(c)
    stop = (F.col("_indent") < F.col("_least")) | (~F.col(f"_{siblings}") & (F.col("_indent") == F.col("_least")) & (nearer > 0) & ~(F.col("_up") & F.col(f"_{header}") & comment))
    x = x.withColumn("_stop", (F.col("_far") > 0) & stop)
    x = x.withColumn("_ended", F.max("_stop").over(side.rowsBetween(W.unboundedPreceding, 0))).where("not _ended")
    x = x.withColumn("_place", F.row_number().over(W.partitionBy(key).orderBy("_far", F.desc("_up")))).where(F.col("_place") <= F.col(f"_{most}"))
    full = F.when(F.trim("_line") != "", F.col("_n"))
    x = x.withColumn("_lo", F.min(full).over(W.partitionBy(key))).withColumn("_hi", F.max(full).over(W.partitionBy(key))).where("_n between _lo and _hi")
    return x.select(key, F.concat(F.lit("L"), F.col("_n").cast("string"), F.lit(": "), tx.left_bytes(F.col("_line"), 500)).alias("line"))
