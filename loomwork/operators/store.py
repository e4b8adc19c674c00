"""Relational store operators: budgets, upserts, deletes, paging, staleness."""

from functools import reduce

from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def within_budget(rows, partition, order, size, cap, bucket=None):
    """Newest rows of each partition whose running size is at most ``cap``; nulls are a partition. ``order`` must be total, sizes not negative (null: 0).

    ``bucket`` is a column that never rises along ``order`` within a partition (the day of a row, newest first); without one a partition is one bucket. Totals by partition and bucket are summed before they
    move, and run up along the buckets; rows of buckets that fit whole are kept as they are, and only the bucket in which the cap falls is
    sorted row by row. So a task holds a bucket, not a partition.
    """
    amount = F.coalesce(F.col(size), F.lit(0))
    x = rows.withColumn("_bucket", F.lit(0) if bucket is None else bucket)
    sums = x.groupBy(*partition, "_bucket").agg(F.sum(amount).alias("_size"))
    along = W.partitionBy(*partition).orderBy(F.desc("_bucket")).rowsBetween(W.unboundedPreceding, 0)
    sums = sums.withColumn("_upto", F.sum("_size").over(along)).where(F.col("_upto") - F.col("_size") <= cap)
    keys = [f"_key{i}" for i in range(len(partition))]
    sums = sums.select(*[F.col(p).alias(k) for p, k in zip(partition, keys, strict=True)], F.col("_bucket").alias("_of"), "_upto", (F.col("_upto") - F.col("_size")).alias("_before"))
    same = reduce(lambda a, b: a & b, [x[p].eqNullSafe(sums[k]) for p, k in zip(partition, keys, strict=True)], x["_bucket"].eqNullSafe(sums["_of"]))
    x = x.join(sums, same).drop(*keys, "_of")
    whole, torn = x.where(F.col("_upto") <= cap), x.where(F.col("_upto") > cap)
    inside = W.partitionBy(*partition, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    torn = torn.withColumn("_running", F.col("_before") + F.sum(amount).over(inside)).where(F.col("_running") <= cap)
    return whole.select(*rows.columns).unionByName(torn.select(*rows.columns))


def watermarks(events):
    """Of each key of ``events(key, seq, action, value)``: status (the last action), input (its watermark), success (the greatest input known at a ``succeed``), pending (input is newer).

    ``enqueue`` brings a watermark; one at or below the known input counts as the known one + 1, so late input is never lost. The known
    input after n of them is therefore n + the greatest of value - ordinal so far (-1 before any): a running maximum, no fold.
    """
    w = W.partitionBy("key").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    new = F.col("action") == "enqueue"
    x = events.withColumn("_n", F.count_if(new).over(w))
    known = F.col("_n") + F.greatest(F.lit(-1), F.max(F.when(new, F.col("value") - F.col("_n"))).over(w))
    x = x.withColumn("_known", known)
    x = x.groupBy("key").agg(F.max_by("action", "seq").alias("status"), F.max("_known").alias("input"), F.coalesce(F.max(F.when(F.col("action") == "succeed", F.col("_known"))), F.lit(-1)).alias("success"))
    return x.withColumn("pending", F.col("input") > F.col("success"))


def partition_totals(rows, partition, size, cap):
    """Partitions whose total size is over ``cap``."""
    return rows.groupBy(*partition).agg(F.sum(size).alias("total_bytes")).where(F.col("total_bytes") > cap)


def paths_by_id(threads, asked):
    """Paths of ``threads(id, archived, path)`` for each row of ``asked(id, archived)``: only archived ones, only others, or (null) either; rows without such a thread or path are left out."""
    x = asked.withColumnRenamed("archived", "_only").join(threads.select("id", "archived", "path"), "id")
    return x.where((F.col("_only").isNull() | (F.col("_only") == F.col("archived"))) & F.col("path").isNotNull()).select("id", F.col("_only").alias("archived"), "path")


def upsert(table, incoming, key, version=None):
    """``incoming`` replaces rows of the same key; with ``version`` only where its version is at least the row's. All columns of ``table``.

    Of several incoming rows of one key and version the greatest stays, by its columns in order (maps aside), so reruns agree.
    """
    both = table.withColumn("_new", F.lit(0)).unionByName(incoming.select(*table.columns).withColumn("_new", F.lit(1)))
    order = ([F.col(version).desc()] if version else []) + [F.col("_new").desc()]
    order += [F.col(f.name).desc() for f in table.schema if not isinstance(f.dataType, T.MapType)]
    return both.withColumn("_rn", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_rn = 1").drop("_rn", "_new")


def insert_absent(table, incoming, key):
    """Adds rows whose key isn't there."""
    return table.unionByName(incoming.select(*table.columns).join(table.select(*key), key, "left_anti"))


def delete_cascade(parent, child, gone, key, child_key):
    """(parent, child) less the keys of ``gone``."""
    keys = gone.select(F.col(key)).distinct()
    return parent.join(keys, key, "left_anti"), child.join(keys.withColumnRenamed(key, child_key), child_key, "left_anti")


def keyset_page(rows, sort, key, anchor, n):
    """The page of ``n`` rows after ``anchor`` (sort value, key), by both descending; one more row tells whether a page follows."""
    after = F.lit(True)
    if anchor is not None:
        after = (F.col(sort) < anchor[0]) | ((F.col(sort) == anchor[0]) & (F.col(key) < anchor[1]))
    return rows.where(after).orderBy(F.desc(sort), F.desc(key)).limit(n + 1)


def log_filter(logs, levels=(), since=None, until=None, like=(), threads=(), threadless=False, after_id=None, contains=None):
    """Rows that meet all given conditions; ``like`` are parts of the message regardless of case (any), ``contains`` minds it."""
    conditions = []
    if levels:
        conditions.append(F.upper("level").isin([x.upper() for x in levels]))
    if since is not None:
        conditions.append(F.col("ts") >= F.lit(since).cast("timestamp"))
    if until is not None:
        conditions.append(F.col("ts") <= F.lit(until).cast("timestamp"))
    if like:
        conditions.append(reduce(lambda a, b: a | b, [F.col("message").ilike(f"%{x}%") for x in like]))
    if threads or threadless:
        conditions.append((F.col("thread_id").isin(list(threads)) if threads else F.lit(False)) | (F.col("thread_id").isNull() if threadless else F.lit(False)))
    if after_id is not None:
        conditions.append(F.col("id") > after_id)
    if contains:
        conditions.append(F.instr("message", contains) > 0)
    return reduce(lambda df, c: df.where(c), conditions, logs)
