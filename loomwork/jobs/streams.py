"""Stream queries (X01-X08, S07, S08, K01, K11): events run as streams to their end, results read back as tables."""

import os
import uuid

from pyspark.sql import functions as F

from loomwork.operators import store
from loomwork.operators.lineage import checkpoint_dir
from loomwork.sources.tables import table
from loomwork.streaming import logs as lg
from loomwork.streaming import items, tables


def scratch(spark):
    """A new folder under the shared checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), f"stream-{uuid.uuid4().hex}")


def _events(spark, sf):
    """``events`` split over files by id, as a stream would find them."""
    at = scratch(spark)
    e = table(spark, sf, "events")
    e.repartitionByRange(max(4, e.rdd.getNumPartitions()), "event_id").write.parquet(f"{at}/in")
    return at, lg.stream(spark, f"{at}/in", e.schema, files_per_trigger=1)


def _done(query):
    query.awaitTermination()


def x01_file_changes(spark, sf):
    """File changes over ten micro-batches: the table after the last. A path is gone if the last batch that has it only removes it."""
    at = scratch(spark)
    e = table(spark, sf, "events")
    for k in range(10):
        e.where(F.col("event_id") % 10 == k).write.mode("append").parquet(f"{at}/in")
        # the stream goes on at its checkpoint: one batch for each run
        changes = lg.stream(spark, f"{at}/in", e.schema).select(F.col("user_id").alias("path"), F.when(F.col("event_type") == "signup", "removed").otherwise("modified").alias("change"), F.col("event_id").alias("version"))
        _done(lg.apply_changes(changes.withColumn("path", F.col("path").cast("string")), f"{at}/out", f"{at}/checkpoint"))
    return tables.read(spark, f"{at}/out").select(F.col("path").cast("long").alias("path"), "version")


def k11_session_index(spark, sf):
    """An index of sessions to which every batch appends: entries of conversations by their turns, the newest of each read back by merging the batches."""
    out, c = scratch(spark), table(spark, sf, "conversations")
    for k in range(3):
        tables.apply(c.where(F.col("turn") % 3 == k).select(F.col("conv_id").cast("string").alias("path"), F.when(F.col("role") == "system", "removed").otherwise("named").alias("change"), F.col("turn").alias("version")), out, k)
    return tables.read(spark, out).select(F.col("path").cast("long").alias("conv_id"), F.col("version").alias("turn"))


def x11_item_stream(spark, sf):
    """Items of conversations that arrive in three parts over three batches, the last parts first, and some without their last part: each is joined and emitted once."""
    at = scratch(spark)
    items.with_rocksdb(spark)
    c = table(spark, sf, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("key"), F.expr("timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(turn as int))").alias("ts"), ((F.col("conv_id") % 5 == 0) & (F.col("turn") % 3 == 1)).alias("torn"), F.explode(items.slices(F.col("text"), 3)).alias("p"))
    parts = c.where(~F.col("torn") | (F.col("p.part") < 2)).select("key", "p.part", F.lit(3).alias("of"), "p.text", "ts")
    over = spark.sql("select '' as key, 0 as part, 1 as of, '' as text, timestamp '2030-01-01' as ts")  # time goes on
    for batch in (parts.where("part = 2"), parts.where("part = 0").unionByName(parts.where("part = 2")), parts.where("part = 1"), over):
        batch.write.mode("append").parquet(f"{at}/in")
        _done(items.run(items.join_parts(lg.stream(spark, f"{at}/in", parts.schema)), f"{at}/out", f"{at}/checkpoint"))
    return spark.read.parquet(f"{at}/out").where("key <> ''").select("key", F.md5("text").alias("digest"), "parts", "complete")


def x02_log_sink(spark, sf):
    at, e = _events(spark, sf)
    _done(lg.sink(e.withColumnRenamed("event_id", "id"), f"{at}/out", f"{at}/checkpoint"))
    return spark.read.parquet(f"{at}/out").groupBy("event_type").agg(F.count("*").alias("n"), F.max("id").alias("last_id"))


def x03_log_tail(spark, sf):
    x = table(spark, sf, "events").select(F.col("event_id").alias("id"), "event_type")
    return lg.tail(x, None, limit=200)


def x04_backfill(spark, sf):
    """A backfill over half of the files, ended, and resumed from its checkpoint when the others have come: every row is read once."""
    at = scratch(spark)
    e = table(spark, sf, "events")
    for part in (e.where("event_id % 2 = 0"), e.where("event_id % 2 <> 0")):
        part.write.mode("append").parquet(f"{at}/in")
        rows = lg.stream(spark, f"{at}/in", e.schema, files_per_trigger=1).select(F.col("event_id").alias("id"), "ts", "user_id")
        _done(lg.sink(rows, f"{at}/out", f"{at}/checkpoint"))
    return spark.read.parquet(f"{at}/out").groupBy("user_id").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def x05_work_states(spark, sf):
    """Sign-ups and views enqueue, purchases succeed, errors fail, clicks claim: last status, input and success watermarks of every user, and whether work is pending."""
    action = F.when(F.col("event_type").isin("signup", "view"), "enqueue").when(F.col("event_type") == "click", "claim").when(F.col("event_type") == "purchase", "succeed").otherwise("fail")
    return store.watermarks(table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), action.alias("action"), (F.col("event_id") % 1000).alias("value")))


def s07_dated_scan(spark, sf):
    """Events by day folders, newest first; the filter prunes folders."""
    at = scratch(spark)
    e = table(spark, sf, "events").select("event_id", "user_id", F.date_format("ts", "yyyy").alias("y"), F.date_format("ts", "MM").alias("m"), F.date_format("ts", "dd").alias("d"))
    e.repartition("y", "m", "d").write.partitionBy("y", "m", "d").parquet(f"{at}/sessions")
    back = spark.read.option("inferSchema", False).schema("event_id long, user_id long, y string, m string, d string").parquet(f"{at}/sessions")
    return back.where("d >= '10'").groupBy("y", "m", "d").agg(F.count("*").alias("n")).orderBy(F.desc("y"), F.desc("m"), F.desc("d"))


def s10_load_lines(spark, sf):
    """Lines of JSON, a tenth of them broken: rows and errors by type."""
    at = scratch(spark)
    line = F.to_json(F.struct("event_id", "event_type"))
    table(spark, sf, "events").select(F.when(F.col("event_id") % 10 == 0, F.substring(line, 1, 9)).otherwise(line).alias("value")).write.text(f"{at}/lines")
    x = spark.read.text(f"{at}/lines").where("trim(value) <> ''").select(F.from_json("value", "event_id long, event_type string, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    bad = F.col("r._corrupt").isNotNull()
    return x.groupBy(F.when(~bad, F.col("r.event_type")).alias("event_type")).agg(F.count("*").alias("n"), F.count_if(bad).alias("errors"))


def k01_snapshot(spark, sf):
    """A snapshot with its version, written and read back; rows of other versions are refused."""
    at = scratch(spark)
    table(spark, sf, "part").withColumn("version", F.lit(1)).write.mode("overwrite").parquet(f"{at}/elements")
    return spark.read.parquet(f"{at}/elements").where("version = 1").groupBy("p_type").agg(F.count("*").alias("n"))


QUERIES = {n: f for n, f in list(globals().items()) if n[:1] in "xsk" and n[1:3].isdigit()}
ORACLES = {
    "x01_file_changes": """WITH c AS (SELECT user_id AS path, event_id % 10 AS batch, max(event_id) FILTER (event_type <> 'signup') AS version FROM events GROUP BY 1, 2)
      SELECT path, version FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY batch DESC) AS rn FROM c) WHERE rn = 1 AND version IS NOT NULL""",
    "k11_session_index": """WITH c AS (SELECT conv_id, turn % 3 AS batch, max(turn) FILTER (role <> 'system') AS turn FROM conversations GROUP BY 1, 2)
      SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY batch DESC) AS rn FROM c) WHERE rn = 1 AND turn IS NOT NULL""",
    "x05_work_states": """WITH RECURSIVE e AS (SELECT user_id AS key, event_id AS seq, CASE WHEN event_type IN ('signup', 'view') THEN 'enqueue' WHEN event_type = 'click' THEN 'claim' WHEN event_type = 'purchase' THEN 'succeed' ELSE 'fail' END AS action,
        event_id % 1000 AS value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
      s(key, n, known, success) AS (SELECT DISTINCT key, 0::BIGINT, -1::BIGINT, -1::BIGINT FROM e UNION ALL SELECT s.key, e.n, CASE WHEN action <> 'enqueue' THEN known WHEN value > known THEN value ELSE known + 1 END,
        CASE WHEN action = 'succeed' THEN greatest(success, known) ELSE success END FROM s JOIN e ON e.key = s.key AND e.n = s.n + 1)
      SELECT key, arg_max(e.action, e.n) AS status, arg_max(known, e.n) AS input, arg_max(success, e.n) AS success, arg_max(known > success, e.n) AS pending FROM s JOIN e USING (key, n) GROUP BY 1""",
    "x11_item_stream": """WITH c AS (SELECT conv_id || ':' || turn AS key, text, CAST(ceil(length(text) / 3.0) AS INTEGER) AS step, conv_id % 5 = 0 AND turn % 3 = 1 AS torn FROM conversations)
      SELECT key, md5(CASE WHEN torn THEN left(text, 2 * step) ELSE text END) AS digest, CAST(CASE WHEN torn THEN 2 ELSE 3 END AS INTEGER) AS parts, NOT torn AS complete FROM c""",
    "x02_log_sink": "SELECT event_type, count(*) AS n, max(event_id) AS last_id FROM events GROUP BY 1",
    "x03_log_tail": "SELECT event_id AS id, event_type FROM events ORDER BY event_id DESC LIMIT 200",
    "x04_backfill": "SELECT user_id, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY 1",
    "s07_dated_scan": "SELECT strftime(ts, '%Y') AS y, strftime(ts, '%m') AS m, strftime(ts, '%d') AS d, count(*) AS n FROM events WHERE strftime(ts, '%d') >= '10' GROUP BY 1, 2, 3",
    "s10_load_lines": "SELECT CASE WHEN event_id % 10 <> 0 THEN event_type END AS event_type, count(*) AS n, count(*) FILTER (event_id % 10 = 0) AS errors FROM events GROUP BY 1",
    "k01_snapshot": "SELECT p_type, count(*) AS n FROM part GROUP BY 1",
}
