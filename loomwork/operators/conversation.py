"""Operators over ordered conversation items."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F


def add_missing_replies(items, key, ord_, role, text):
    """After every user item that no assistant item follows directly, an assistant item "aborted" at ord + 0.5."""
    w = W.partitionBy(key).orderBy(ord_)
    open_ = items.withColumn("_next", F.lead(role).over(w)).where((F.col(role) == "user") & ~F.col("_next").eqNullSafe("assistant"))
    made = open_.select(F.col(key), (F.col(ord_) + F.lit(0.5)).alias(ord_), F.lit("assistant").alias(role), F.lit("aborted").alias(text))
    return items.select(key, F.col(ord_).cast("double").alias(ord_), role, text).unionByName(made)


def drop_orphan_replies(items, key, ord_, role):
    """Less assistant items that no user item precedes directly."""
    w = W.partitionBy(key).orderBy(ord_)
    return items.withColumn("_last", F.lag(role).over(w)).where((F.col(role) != "assistant") | F.col("_last").eqNullSafe("user")).drop("_last")


#: The kinds of calls, each with the kind of its output.
OUTPUTS = {"function_call": "function_output", "shell_call": "function_output", "custom_call": "custom_output"}


def _answer(kind):
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in OUTPUTS.items() for x in kv]), F.col(kind))


def add_missing_outputs(items, key, ord_, kind, call_id):
    """(key, ord, kind, call_id, aborted) with an "aborted" output at ord + 0.5 for calls whose id has no output of their kind. Null ids need none.

    Repeated calls of an id without output get one each.
    """
    rows = items.select(key, F.col(ord_).cast("double").alias(ord_), kind, call_id)
    calls = rows.withColumn("_want", _answer(kind)).where(F.col("_want").isNotNull() & F.col(call_id).isNotNull())
    have = rows.select(key, F.col(kind).alias("_want"), call_id).where(F.col("_want").isin(*set(OUTPUTS.values()))).distinct()
    made = calls.join(have, [key, "_want", call_id], "left_anti").select(key, (F.col(ord_) + 0.5).alias(ord_), F.col("_want").alias(kind), call_id, F.lit(True).alias("aborted"))
    return rows.withColumn("aborted", F.lit(False)).unionByName(made)


def drop_orphan_outputs(items, key, kind, call_id):
    """Less outputs without a call of their id that gives their kind; outputs with a null id go too."""
    calls = items.select(key, _answer(kind).alias("_k"), call_id).where("_k is not null").distinct().withColumn("_called", F.lit(True))
    x = items.withColumn("_k", F.when(F.col(kind).isin(*set(OUTPUTS.values())), F.col(kind))).join(calls, [key, "_k", call_id], "left")
    return x.where(F.col("_k").isNull() | F.col("_called")).select(*items.columns)


def drop_counterparts(items, removed, key, ord_, kind, call_id):
    """Less, for each ``removed`` call or output, the first item by ``ord`` that is its other end: an output of a call, a call of an output (function calls before shell calls).

    Several removed items with the same counterpart take one item.
    """
    wanted = removed.select(key, call_id, F.explode(F.array_compact(F.array(
        F.coalesce(_answer(kind), F.when(F.col(kind) == "function_output", F.lit("calls")), F.when(F.col(kind) == "custom_output", F.lit("custom_call"))),
    ))).alias("_end")).distinct()
    ends = items.withColumn("_end", F.when(F.col(kind).isin("function_call", "shell_call"), F.lit("calls")).otherwise(F.col(kind)))
    gone = ends.join(wanted, [key, call_id, "_end"]).groupBy(key, call_id, "_end").agg(F.min(F.struct((F.col(kind) == "shell_call").alias("late"), F.col(ord_).alias("at"))).alias("_gone"))
    return items.join(gone.select(key, F.col("_gone.at").alias(ord_)).distinct(), [key, ord_], "left_anti").select(*items.columns)


def select_newest(items, key, ord_, size, budget):
    """Newest first, whole items while they fit in ``budget``; the first that doesn't is ``cut`` to what is left, older ones go."""
    w = W.partitionBy(key).orderBy(F.desc(ord_)).rowsBetween(W.unboundedPreceding, -1)
    x = items.withColumn("before", F.coalesce(F.sum(size).over(w), F.lit(0)))
    return x.where(F.col("before") < budget).withColumn("taken", F.least(F.col(size), budget - F.col("before"))).drop("before")


def turns(items, key, ord_, role):
    """Numbers turns: a user item begins one; what comes before the first has turn 0."""
    w = W.partitionBy(key).orderBy(ord_).rowsBetween(W.unboundedPreceding, 0)
    return items.withColumn("turn_no", F.sum((F.col(role) == "user").cast("long")).over(w))


def roll_back(events, key, ord_, kind, n):
    """Turns left by a log of ``turn`` and ``rollback`` events: a rollback removes the last ``n`` turns still there, all if there are fewer.

    By a reflected sum: with +1 for a turn and -n for a rollback, the turns there are the running sum less its least value so far, if that is
    below 0. A turn is left if there are never fewer turns later than right after it. Null keys are a log of their own; a null or negative n removes nothing.
    """
    w = W.partitionBy(key).orderBy(ord_)
    so_far, later = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    x = events.withColumn("_sum", F.sum(F.when(F.col(kind) == "rollback", -F.greatest(F.coalesce(F.col(n), F.lit(0)), F.lit(0))).otherwise(1)).over(so_far))
    x = x.withColumn("_depth", F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(so_far))).withColumn("_least", F.min("_depth").over(later))
    return x.where((F.col(kind) != "rollback") & (F.col("_least") >= F.col("_depth"))).select(key, ord_)


def head_tail(chunks, key, ord_, data, most):
    """What a buffer of ``most`` bytes keeps of each key's binary ``data`` in order: the first half of the budget and the last bytes behind it. One row for each kept piece: key, ord, part, data.

    A chunk on a border is cut at the byte; a piece's place follows from the bytes before it and the total, so nothing is appended step by step. Null data are empty.
    """
    head, tail = most // 2, most - most // 2
    size = F.coalesce(F.octet_length(data), F.lit(0)).cast("long")
    w = W.partitionBy(key)
    x = chunks.select(key, ord_, data, size.alias("_size"))
    x = x.withColumn("_to", F.sum("_size").over(w.orderBy(ord_).rowsBetween(W.unboundedPreceding, 0))).withColumn("_from", F.col("_to") - F.col("_size")).withColumn("_total", F.sum("_size").over(w))
    later = F.greatest(F.lit(head), F.col("_total") - tail)  # where the tail begins
    piece = lambda lo, hi: F.substring(data, (lo - F.col("_from") + 1).cast("int"), (hi - lo).cast("int"))
    first = F.struct(F.lit("head").alias("part"), piece(F.col("_from"), F.least(F.col("_to"), F.lit(head))).alias("data"))
    last = F.struct(F.lit("tail").alias("part"), piece(F.greatest(F.col("_from"), later), F.col("_to")).alias("data"))
    kept = F.filter(F.array(F.when((F.col("_size") > 0) & (F.col("_from") < head), first), F.when((F.col("_size") > 0) & (F.col("_to") > later), last)), lambda p: p.isNotNull())
    return x.select(key, ord_, F.explode(kept).alias("_p")).select(key, ord_, "_p.part", "_p.data")
