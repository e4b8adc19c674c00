"""Begin and end events of sessions as items with numbers of their own."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F


def items(events, session, order, call, what, bucket):
    """``events`` with event, item and begun: items start at ``begin``, complete at ``end``; other kinds are items complete at once.

    An end belongs to the last begin of its session and ``call`` that no end follows yet (``begun``: its id)
    and shares its item; any other end is an item of its own. Null calls pair with nothing. Items
    are numbered from 0 in the order in which they begin. ``order``: columns of a total order, an id last; ``bucket`` is a column that
    never falls along it (a day): numbers are counted by bucket before they move, then within a bucket, so no task holds a session.
    """
    at = order[-1]
    both = F.col(what).isin("begin", "end") & F.col(call).isNotNull()
    near = W.partitionBy(session, call).orderBy(*order)
    paired = events.where(both).withColumn("_kind", F.lag(what).over(near)).withColumn("_at", F.lag(at).over(near))
    paired = paired.withColumn("begun", F.when((F.col(what) == "end") & (F.col("_kind") == "begin"), F.col("_at"))).drop("_kind", "_at")
    none = F.lit(None).cast(events.schema[at].dataType)
    x = paired.unionByName(events.where(~both | F.col(what).isNull()).withColumn("begun", none)).withColumn("_new", F.col("begun").isNull().cast("int")).withColumn("_bucket", bucket)
    sums = x.groupBy(session, "_bucket").agg(F.sum("_new").alias("_sum"))
    along = W.partitionBy(session).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(F.col(session).alias("_of"), F.col("_bucket").alias("_in"), F.coalesce(F.sum("_sum").over(along), F.lit(0)).alias("_before"))
    inside = W.partitionBy(session, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    x = x.join(sums, x[session].eqNullSafe(sums["_of"]) & x["_bucket"].eqNullSafe(sums["_in"])).withColumn("_no", F.col("_before") + F.sum("_new").over(inside) - 1)
    starts = x.where((F.col("_new") == 1) & (F.col(what) == "begin")).select(F.col(session).alias("_s"), F.col(at).alias("_b"), F.col("_no").alias("_its"))
    x = x.join(starts, x[session].eqNullSafe(starts["_s"]) & (x["begun"] == starts["_b"]), "left")
    event = F.when(F.col(what) == "begin", "item.started").otherwise("item.completed")
    return x.select(*events.columns, event.alias("event"), F.concat(F.lit("item_"), F.coalesce("_its", "_no").cast("string")).alias("item"), "begun")
