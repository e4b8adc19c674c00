"""Log rows and file changes as streams."""

from pyspark.sql import functions as F

from loomwork.streaming import tables


def stream(spark, path, schema, files_per_trigger=None, glob=None):
    """Parquet files under ``path`` as a stream."""
    r = spark.readStream.schema(schema)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.parquet(path)


def sink(rows, out, checkpoint):
    """Appends every row of each micro-batch to the Parquet table ``out``, rows with equal ids too. Resumes at ``checkpoint``.

    A batch is written to a folder of its own number, so a batch that is run again after a failure replaces itself.
    """

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tail(logs, after_id, limit=None):
    """Rows after an id, in order; ``limit`` takes the newest ones (the first look back)."""
    if limit is None:
        return logs.where(F.col("id") > after_id).orderBy("id")
    return logs.orderBy(F.desc("id")).limit(limit).orderBy("id")


def apply_changes(changes, out, checkpoint):
    """Keeps a table path, version of changed files: of a batch, removals go first, then the changed paths once each. Each batch writes a delta; ``tables.read`` merges them.

    ``changes(path, change, version)``.
    """
    return changes.writeStream.foreachBatch(lambda batch, number: tables.apply(batch, out, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
