"""Queries over ``nodes(id, kind, name, ord)`` and ``edges(src_id, dst_id, kind)``; edges are a bag."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwork.operators.lineage import cut


def neighbours(nodes, edges, kind, incoming, distinct=False):
    """The other ends of edges of ``kind`` for ``nodes(id, name)``: id, name, other. One row per edge unless ``distinct``."""
    here, there = ("dst_id", "src_id") if incoming else ("src_id", "dst_id")
    e = edges.where(F.col("kind") == kind).select(F.col(here).alias("id"), F.col(there).alias("other"))
    out = nodes.select("id", "name").join(e, "id")
    return out.distinct() if distinct else out


def within_hops(edges, seeds, hops):
    """Nodes at 1 to ``hops`` steps of ``seeds(id)``, any kind and direction, seeds excluded: id, hops (the least). Each frontier cuts its lineage; ends early when one is empty."""
    both = edges.select(F.col("src_id").alias("a"), F.col("dst_id").alias("b"))
    both = cut(both.union(both.select("b", "a")).distinct().repartition("a"))  # read at every hop
    front = cut(seeds.select("id").distinct().withColumn("hops", F.lit(0)))
    seen = front
    for k in range(1, hops + 1):
        step = both.join(front.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        front = cut(step.join(seen, "id", "left_anti").withColumn("hops", F.lit(k)))
        seen = seen.unionByName(front)
        if front.isEmpty():
            break
    return seen.where("hops > 0")


def shortest_paths(edges, sources, targets, max_hops=None, kinds=None):
    """Shortest directed paths: source, target, hops, path ('>'-joined; the first by text among equals).

    The search goes backwards from the targets, which should be the fewer side, and keeps for each target and node the rest of its
    path; it ends when no new node is found, or after ``max_hops``. ``kinds`` filters edges; source = target is a path of 0 hops.
    """
    e = (edges.where(F.col("kind").isin(list(kinds))) if kinds else edges).select(F.col("src_id").alias("before"), F.col("dst_id").alias("at")).distinct()
    e = cut(e.repartition("at"))  # read at every hop
    front = cut(targets.select(F.col("id").alias("target"), F.col("id").alias("at"), F.col("id").alias("path"), F.lit(0).alias("hops")).distinct())
    seen, k = front, 0
    while not front.isEmpty() and (max_hops is None or k < max_hops):
        k += 1
        step = front.join(e, "at").groupBy("target", F.col("before").alias("at")).agg(F.min(F.concat_ws(">", "before", "path")).alias("path"))
        front = cut(step.join(seen, ["target", "at"], "left_anti").withColumn("hops", F.lit(k)).select("target", "at", "path", "hops"))
        seen = seen.unionByName(front)
    return seen.join(sources.select(F.col("id").alias("at")).distinct(), "at").select(F.col("at").alias("source"), "target", "hops", "path")


def first_by(rows, key, *order):
    """One row per key: the first in order."""
    return rows.withColumn("_rn", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_rn = 1").drop("_rn")


def least_in_band(asks, points, width):
    """``asks(ask, name, at)`` with ``least``: the least ``key`` of ``points(key, name, at)`` of the same name with ``ask.at < at < ask.at + width``; asks without one are left out.

    Points are dealt to steps of ``width``, so a band ends in the step behind the one it begins in: its least is that of the first step's rest and of the last step's beginning,
    running minima over asks and points in order instead of pairs of them. Bands that rounding ends elsewhere meet the points of their steps. Numbers that aren't finite are in no band.
    """
    step, real = F.floor(F.col("at") / width), F.abs("at") < float("inf")
    points = points.where(real & F.col("name").isNotNull()).withColumn("step", step)
    ends = asks.where(real & F.col("name").isNotNull()).withColumn("step", step).withColumn("end", F.col("at") + F.lit(float(width))).withColumn("last", F.floor(F.col("end") / width))
    plain, none = F.coalesce(F.col("last") == F.try_add("step", F.lit(1)), F.lit(False)), F.lit(None)
    sides = [(points.select("name", "step", F.lit(up).alias("up"), F.when(F.lit(up), F.col("at")).otherwise(-F.col("at")).alias("at"), F.lit(1).alias("point"), none.cast(asks.schema["ask"].dataType).alias("ask"), "key")) for up in (True, False)]
    key = none.cast(points.schema["key"].dataType).alias("key")
    first = ends.where(plain).select("name", "step", F.lit(False), -F.col("at"), F.lit(0), "ask", key)
    last = ends.where(plain).select("name", "last", F.lit(True), "end", F.lit(0), "ask", key)
    # an ask stands before the points of equal number, which aren't in its band
    before = W.partitionBy("name", "step", "up").orderBy("at", "point").rowsBetween(W.unboundedPreceding, W.currentRow)
    found = sides[0].union(sides[1]).union(first).union(last).withColumn("least", F.min("key").over(before)).where("point = 0 and least is not null").select("ask", "least")
    odd = ends.where(~plain).select("ask", "name", F.col("at").alias("begin"), "end", F.explode(F.sequence("step", "last")).alias("step")).join(points, ["name", "step"])
    return found.union(odd.where("at > begin and at < end").select("ask", "key")).groupBy("ask").agg(F.min("least").alias("least"))


def starting_with(rows, column, names, name):
    """Rows whose ``column`` starts with any of ``names``, repeated rows as often as they are there; all rows if there are no names. An equi-join of the column's distinct values, by all beginnings of the names' lengths."""
    wanted = cut(names.select(F.col(name).alias("_begin")).where("_begin is not null").distinct())
    sizes = [r[0] for r in wanted.select(F.length("_begin")).distinct().collect()]  # lengths of names
    if not sizes and names.isEmpty():
        return rows
    cuts = F.array_distinct(F.array(*[F.substring(column, 1, n) for n in sorted(sizes)])) if sizes else F.array().cast("array<string>")
    fit = rows.select(column).distinct().withColumn("_begin", F.explode(cuts)).join(wanted, "_begin", "left_semi").select(column).distinct()
    return rows.join(fit, column, "left_semi").select(*rows.columns)


def remove(nodes, edges, gone):
    """(nodes, edges) less the nodes of ``gone(id)`` and all edges at either end."""
    ids = gone.select("id").distinct()
    kept = edges.join(ids, F.col("src_id") == F.col("id"), "left_anti").join(ids, F.col("dst_id") == F.col("id"), "left_anti")
    return nodes.join(ids, "id", "left_anti"), kept


def replace(nodes, edges, new_nodes, new_edges, changed):
    """Rows of the changed nodes' owners replaced; edges into them stay if their target is still there, as in a full rebuild."""
    ids = changed.select("id").distinct()
    kept_nodes = nodes.join(ids, "id", "left_anti").unionByName(new_nodes)
    kept = edges.join(ids, F.col("src_id") == F.col("id"), "left_anti").unionByName(new_edges)
    return kept_nodes, kept.join(kept_nodes.select(F.col("id").alias("dst_id")).distinct(), "dst_id", "left_semi").select(*edges.columns)
