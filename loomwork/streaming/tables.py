"""Tables of the latest version by path, kept as a base and deltas: each batch writes a run of its own, reads merge the runs.

A run holds the paths of a batch with their version, null for removed ones (tombstones). The newest run with a path wins. When ``FAN`` runs of
one tier have come together, they are merged to one of the next tier (older first, so tiers keep their order); a merge that takes in
the oldest run drops tombstones. So a row is written once for each tier, and a batch doesn't rewrite the table. The list of live runs is written last, under the batch's number: a batch that
is run again replaces its runs and its list, and starts from the list before it.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

FAN = 4
MANIFEST = "batch long, ord long, run string, tier int, rows long, written long"


def _manifests(spark, out):
    try:
        return spark.read.schema(MANIFEST).parquet(f"{out}/manifest/*")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None


def runs(spark, out, before=None):
    """Live runs after the last batch (or the last one before a number), oldest first: FAN - 1 for each tier at most."""
    m = _manifests(spark, out)
    if m is None:
        return []
    m = m if before is None else m.where(F.col("batch") < before)
    last = m.agg(F.max("batch")).first()[0]
    return m.where((F.col("batch") == last) & F.col("run").isNotNull()).orderBy("ord").collect() if last is not None else []


def history(spark, out):
    """batch, written: the rows that each batch wrote, merges included."""
    return _manifests(spark, out).groupBy("batch").agg(F.max("written").alias("written"))


def _merged(spark, out, names):
    """The newest row of each path over some runs, given oldest first."""
    parts = [spark.read.schema("path string, version long").parquet(f"{out}/runs/{name}").withColumn("_ord", F.lit(k)) for k, name in enumerate(names)]
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    return every.groupBy("path").agg(F.max_by(F.struct("version"), "_ord")["version"].alias("version"))


def apply(batch, out, number):
    """One batch of ``batch(path, change, version)``: removals first, then the changed paths once each, with their greatest version. Null paths are left out."""
    spark = batch.sparkSession
    live = [(r["run"], r["tier"], r["rows"]) for r in runs(spark, out, number)]
    new = batch.where("path is not null").groupBy("path").agg(F.max(F.when(F.col("change") != "removed", F.col("version"))).alias("version"))
    written = 0

    def write(df, name, tier):
        nonlocal written
        df.write.mode("overwrite").parquet(f"{out}/runs/{name}")
        rows = spark.read.parquet(f"{out}/runs/{name}").count()
        written += rows
        return (name, tier, rows)

    live.append(write(new, f"{number}", 0))
    while len(live) >= FAN and len({tier for _, tier, _ in live[-FAN:]}) == 1:
        tier, merged = live[-1][1] + 1, _merged(spark, out, [name for name, _, _ in live[-FAN:]])
        if len(live) == FAN:
            merged = merged.where("version is not null")
        live = [*live[:-FAN], write(merged, f"{number}-{tier}", tier)]
    rows = [(number, k, *run, written) for k, run in enumerate(live)]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{out}/manifest/{number}")


def read(spark, out):
    """path, version: the table after the last batch; None before the first."""
    live = runs(spark, out)
    return _merged(spark, out, [r["run"] for r in live]).where("version is not null") if live else None
