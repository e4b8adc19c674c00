"""Store queries (S18-S20, K, P, A01-A05, A15, A16, W01-W03, J08, J09, O, U, X09, X15) over events and orders."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwork.operators import store
from loomwork.sources.tables import LOGS_SQL, logs, table


def _newest():
    return [F.desc("ts"), F.desc("id")]


def _day():
    return F.date_trunc("day", "ts")


def _orders(spark, sf):
    return table(spark, sf, "orders")


def _thread(spark, sf):
    """Orders as threads: id, owner, status, updated (epoch seconds), provider (null for the default one)."""
    o = _orders(spark, sf)
    provider = F.when(F.col("o_orderpriority") == "5-LOW", None).otherwise(F.col("o_orderpriority"))
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner"), F.col("o_orderstatus").alias("status"), F.unix_timestamp("o_orderdate").alias("updated"), provider.alias("provider"), F.col("o_totalprice").alias("price"))


THREAD_SQL = """thread AS (SELECT o_orderkey AS id, o_custkey AS owner, o_orderstatus AS status, CAST(epoch(o_orderdate) AS BIGINT) AS updated,
  CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority END AS provider, o_totalprice AS price FROM orders)"""


def s18_point_lookup(spark, sf):
    return _thread(spark, sf).where("id = 42")


def s19_ordered_children(spark, sf):
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    kids = line.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("kids"))
    return kids.select("l_orderkey", F.array_join(F.transform("kids", lambda k: k["l_partkey"].cast("string")), ",").alias("parts"))


def s20_path_by_id(spark, sf):
    """Lookup with a three-way filter: only archived, only active, either."""
    t = _thread(spark, sf).where("status in ('F', 'O')")
    return t.select("id", "status", F.when(F.col("status") == "F", F.lit("archived")).otherwise(F.lit("active")).alias("root"))


def s20_paths_asked(spark, sf):
    """Paths of the orders that lines ask for, by a three-way argument."""
    t = _thread(spark, sf).select("id", (F.col("status") == "F").alias("archived"), F.when(F.col("id") % 11 != 0, F.concat(F.lit("sessions/"), F.col("id").cast("string"))).alias("path"))
    only = F.when(F.col("l_linenumber") % 3 == 0, True).when(F.col("l_linenumber") % 3 == 1, False)
    return store.paths_by_id(t, table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), only.alias("archived")))


def k02_insert_logs(spark, sf):
    return logs(spark, sf).select("id", "estimated_bytes")


def _incoming(spark, sf):
    return _thread(spark, sf).where("provider is null").withColumn("status", F.lit("X")).withColumn("updated", F.col("updated") + F.when(F.col("id") % 2 == 0, 86400).otherwise(-86400))


def k03_upsert(spark, sf):
    return store.upsert(_thread(spark, sf), _incoming(spark, sf), ["id"])


def k04_insert_absent(spark, sf):
    new = _incoming(spark, sf).withColumn("id", F.col("id") * 2)
    return store.insert_absent(_thread(spark, sf).where("status <> 'P'"), new, ["id"]).select("id", "status", "updated")


def k05_conditional_upsert(spark, sf):
    return store.upsert(_thread(spark, sf), _incoming(spark, sf), ["id"], version="updated").select("id", "status", "updated")


def k06_retention(spark, sf):
    x = logs(spark, sf)
    cutoff = x.agg((F.max("ts") - F.expr("interval 10 days")).alias("cutoff"))
    return x.join(F.broadcast(cutoff)).where("ts >= cutoff").select("id")


def k07_delete_cascade(spark, sf):
    t, line = _thread(spark, sf), table(spark, sf, "lineitem")
    parent, child = store.delete_cascade(t, line, t.where("status = 'P'"), "id", "l_orderkey")
    kids = child.groupBy("l_orderkey").agg(F.count("*").alias("kids")).withColumnRenamed("l_orderkey", "id")
    return parent.join(kids, "id", "left").select("id", F.coalesce("kids", F.lit(0)).alias("kids"))


def k08_clear_kinds(spark, sf):
    return logs(spark, sf).where(~F.col("level").isin("view", "click")).groupBy("level").agg(F.count("*").alias("n"))


def k09_archive(spark, sf):
    t = _thread(spark, sf)
    gone = F.col("provider").isNull()
    return t.select("id", F.when(gone, "archived").otherwise(F.col("status")).alias("status"), F.when(gone, F.col("updated")).alias("archived_at"))


def k10_trim_history(spark, sf):
    """Keeps the newest lines within max(0.8 * cap, newest line) of a conversation, cap 1,000 bytes."""
    h = table(spark, sf, "conversations").select("conv_id", "turn", F.octet_length("text").cast("long").alias("bytes"))
    newest = W.partitionBy("conv_id").orderBy(F.desc("turn"))
    h = h.withColumn("target", F.greatest(F.lit(800), F.first("bytes").over(newest))).withColumn("running", F.sum("bytes").over(newest.rowsBetween(W.unboundedPreceding, 0)))
    return h.where("running <= target").select("conv_id", "turn", "bytes")


def k12_persist_kinds(spark, sf):
    keep = F.when(F.col("level").isin("error", "purchase", "signup"), "always").when((F.col("level") == "view") & (F.col("value") > 10), "extended")
    return logs(spark, sf).select("id", keep.alias("mode")).where("mode is not null")


def p02_log_filter(spark, sf):
    return store.log_filter(logs(spark, sf), levels=["ERROR", "view", "click"], since="2024-01-03 00:00:00", like=["K\": 1", "k\": 7"], threads=range(0, 4000, 3), threadless=True, after_id=100, contains="k").select("id", "level", "thread_id")


def p03_thread_filter(spark, sf):
    return _thread(spark, sf).where("status <> 'P' and price > 1000 and owner % 2 = 1 and provider in ('1-URGENT', '2-HIGH')").select("id", "owner", "updated")


def p04_provider_match(spark, sf):
    return _thread(spark, sf).where(F.coalesce("provider", F.lit("default")).isin("default", "1-URGENT")).groupBy("provider").agg(F.count("*").alias("n"))


def p05_split_filter(spark, sf):
    """A condition that the scan can prune and one that it can't; Catalyst splits them."""
    return _orders(spark, sf).where((F.col("o_orderstatus") == "O") & (F.length(F.regexp_replace("o_orderpriority", "[^A-Z]", "")) > 4)).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


def a01_over_cap(spark, sf):
    x = logs(spark, sf).where("thread_id is not null")
    return store.partition_totals(x, ["thread_id"], "estimated_bytes", 300)


def a02_null_partition_sum(spark, sf):
    return logs(spark, sf).where("thread_id is null and process_id is null").agg(F.coalesce(F.sum("estimated_bytes"), F.lit(0)).alias("total_bytes"))


def a03_max_id(spark, sf):
    return logs(spark, sf).groupBy("level").agg(F.coalesce(F.max(F.when(F.col("thread_id").isNull(), F.col("id"))), F.lit(0)).alias("max_id"))


def a04_leases(spark, sf):
    """Of each owner's waiting orders, as many as owner has free leases of 8, oldest first."""
    t = _thread(spark, sf)
    live = t.where("status = 'P'").groupBy("owner").agg(F.count("*").alias("live"))
    wait = t.where("status = 'O'").withColumn("rn", F.row_number().over(W.partitionBy("owner").orderBy("updated", "id")))
    return wait.join(live, "owner", "left").where("rn <= 8 - coalesce(live, 0)").select("id", "owner")


def a05_watermark(spark, sf):
    t = _thread(spark, sf).where("status = 'F'")
    claimed = F.lit(820454400).cast("long")
    return t.groupBy("owner").agg(F.greatest(F.coalesce(F.max("updated"), claimed), claimed).alias("watermark"))


def a15_batch_outcomes(spark, sf):
    t = _thread(spark, sf)
    return t.groupBy(F.floor(F.col("id") / 200).alias("batch")).agg(F.count_if(F.col("status") == "F").alias("done"), F.count_if(F.col("status") != "F").alias("failed"))


def a16_distinct_ids(spark, sf):
    return logs(spark, sf).select("thread_id").where("thread_id is not null").distinct()


def w01_thread_budget(spark, sf):
    return store.within_budget(logs(spark, sf).where("thread_id is not null"), ["thread_id"], _newest(), "estimated_bytes", 120, _day()).select("id")


def w02_process_budget(spark, sf):
    return store.within_budget(logs(spark, sf).where("thread_id is null and process_id is not null"), ["process_id"], _newest(), "estimated_bytes", 4000, _day()).select("id")


def w03_null_process_budget(spark, sf):
    return store.within_budget(logs(spark, sf).where("thread_id is null"), ["process_id"], _newest(), "estimated_bytes", 2000, _day()).select("id", "process_id")


def _stage(spark, sf):
    line = table(spark, sf, "lineitem").where("l_returnflag <> 'R'")
    return line.groupBy("l_orderkey").agg(F.max(F.unix_timestamp("l_shipdate")).alias("shipped"), F.count("*").alias("lines")).withColumnRenamed("l_orderkey", "id")


STAGE_SQL = "stage AS (SELECT l_orderkey AS id, CAST(max(epoch(l_shipdate)) AS BIGINT) AS shipped, count(*) AS lines FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1)"


def j08_stale(spark, sf):
    """Threads without output, or with output or success older than the thread."""
    jobs = table(spark, sf, "labels").where("toxic = 0").select(F.col("doc_id").alias("id"), F.col("quality").alias("ok"))
    x = _thread(spark, sf).join(_stage(spark, sf), "id", "left").join(jobs, "id", "left")
    return x.where("coalesce(shipped, -1) < updated and coalesce(ok, -1) < 1").select("id", "updated", "shipped", "ok")


def j09_outputs_with_owner(spark, sf):
    x = _stage(spark, sf).join(_thread(spark, sf).select("id", "owner", "provider"), "id", "left")
    return x.where("length(trim(coalesce(provider, ''))) > 0 or lines > 3").orderBy(F.desc("shipped"), F.desc("id")).limit(500).select("id", "owner", "lines", "shipped")


def x09_candidates(spark, sf):
    """Within the scan limit of 5,000, stale threads of a window of age, at most 64."""
    t = _thread(spark, sf).where("updated between 725846400 and 883612800").orderBy(F.desc("updated"), F.desc("id")).limit(5000)
    x = t.join(_stage(spark, sf), "id", "left").where("coalesce(shipped, -1) < updated + 5000000")
    return x.orderBy(F.desc("updated"), F.desc("id")).limit(64).select("id", "updated")


ANCHOR = (883612800, 500)


def o01_keyset_page(spark, sf):
    return store.keyset_page(_thread(spark, sf), "updated", "id", ANCHOR, 100).select("id", "updated", "status")


def o02_created_page(spark, sf):
    created = _thread(spark, sf).withColumn("created", F.expr("updated - (id % 30) * 86400"))
    return store.keyset_page(created, "created", "id", (883612800, 500), 50).select("id", "created")


def o03_cursor(spark, sf):
    cursor = F.concat_ws("|", F.date_format(F.timestamp_seconds("updated"), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.col("id").cast("string"))
    x = _thread(spark, sf).select("id", cursor.alias("cursor"))
    return x.select("id", "cursor", F.unix_timestamp(F.to_timestamp(F.split("cursor", r"\|")[0])).alias("ts"), F.split("cursor", r"\|")[1].cast("long").alias("key"))


def o05_ids_only(spark, sf):
    return store.keyset_page(_thread(spark, sf).where("status = 'F'"), "updated", "id", None, 25).select("id")


def o06_offset_page(spark, sf):
    return _thread(spark, sf).orderBy("id").offset(100).limit(25).select("id", "owner")


def o07_log_order(spark, sf):
    return logs(spark, sf).where("level = 'error'").orderBy(F.desc("id")).limit(200).select("id", "message")


def o08_top_k(spark, sf):
    return logs(spark, sf).orderBy(F.desc("value"), "id").limit(20).select("id", "value")


def u01_union_roots(spark, sf):
    t = _thread(spark, sf)
    both = t.where("status = 'F'").withColumn("archived", F.lit(True)).unionByName(t.where("status <> 'F'").withColumn("archived", F.lit(False)))
    return both.groupBy("archived", "owner").agg(F.count("*").alias("n"))


def u02_distinct_sorted(spark, sf):
    return table(spark, sf, "part").select("p_brand", "p_type").distinct().orderBy("p_brand", "p_type")


def x15_recent_buffer(spark, sf):
    """The newest 20 rows of each level with the level's total."""
    x = logs(spark, sf).select("id", "level", "ts")
    newest = x.withColumn("rn", F.row_number().over(W.partitionBy("level").orderBy(*_newest()))).where("rn <= 20").select("id", "level")  # limited before it is shuffled
    total = x.groupBy("level").agg(F.count("*").alias("total"))
    return newest.join(total, newest["level"].eqNullSafe(total["level"])).select("id", newest["level"], "total")


QUERIES = {n: f for n, f in list(globals().items()) if n[:1] in "skpawjoux" and n[1:3].isdigit()}
L, T = f"WITH {LOGS_SQL}", f"WITH {THREAD_SQL}"
INCOMING_SQL = "inc AS (SELECT id, owner, 'X' AS status, updated + CASE WHEN id % 2 = 0 THEN 86400 ELSE -86400 END AS updated, provider, price FROM thread WHERE provider IS NULL)"
RUNNING = "sum(estimated_bytes) OVER (PARTITION BY {} ORDER BY ts DESC, id DESC ROWS UNBOUNDED PRECEDING)"
ORACLES = {
    "s18_point_lookup": f"{T} SELECT * FROM thread WHERE id = 42",
    "s19_ordered_children": "SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS parts FROM lineitem GROUP BY 1",
    "s20_paths_asked": """SELECT o_orderkey AS id, archived, 'sessions/' || o_orderkey AS path FROM orders JOIN (SELECT l_orderkey, CASE l_linenumber % 3 WHEN 0 THEN true WHEN 1 THEN false END AS archived FROM lineitem) ON l_orderkey = o_orderkey
      WHERE o_orderkey % 11 <> 0 AND (archived IS NULL OR archived = (o_orderstatus = 'F'))""",
    "s20_path_by_id": f"{T} SELECT id, status, CASE WHEN status = 'F' THEN 'archived' ELSE 'active' END AS root FROM thread WHERE status IN ('F', 'O')",
    "k02_insert_logs": f"{L} SELECT id, estimated_bytes FROM logs",
    "k03_upsert": f"{T}, {INCOMING_SQL} SELECT * FROM inc UNION ALL SELECT * FROM thread WHERE id NOT IN (SELECT id FROM inc)",
    "k04_insert_absent": f"{T}, {INCOMING_SQL}, base AS (SELECT * FROM thread WHERE status <> 'P') SELECT id, status, updated FROM base UNION ALL SELECT id * 2, status, updated FROM inc WHERE id * 2 NOT IN (SELECT id FROM base)",
    "k05_conditional_upsert": f"{T}, {INCOMING_SQL} SELECT t.id, CASE WHEN i.updated >= t.updated THEN i.status ELSE t.status END AS status, CASE WHEN i.updated >= t.updated THEN i.updated ELSE t.updated END AS updated FROM thread t LEFT JOIN inc i USING (id)",
    "k06_retention": f"{L} SELECT id FROM logs WHERE ts >= (SELECT max(ts) - INTERVAL 10 DAY FROM logs)",
    "k07_delete_cascade": f"{T} SELECT t.id, count(l.l_orderkey) AS kids FROM thread t LEFT JOIN lineitem l ON l.l_orderkey = t.id WHERE t.status <> 'P' GROUP BY 1",
    "k08_clear_kinds": f"{L} SELECT level, count(*) AS n FROM logs WHERE level NOT IN ('view', 'click') GROUP BY 1",
    "k09_archive": f"{T} SELECT id, CASE WHEN provider IS NULL THEN 'archived' ELSE status END AS status, CASE WHEN provider IS NULL THEN updated END AS archived_at FROM thread",
    "k10_trim_history": "WITH h AS (SELECT conv_id, turn, CAST(strlen(text) AS BIGINT) AS bytes FROM conversations), r AS (SELECT *, sum(bytes) OVER w AS running, greatest(800, first_value(bytes) OVER w) AS target FROM h WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING)) SELECT conv_id, turn, bytes FROM r WHERE running <= target",
    "k12_persist_kinds": f"{L} SELECT * FROM (SELECT id, CASE WHEN level IN ('error', 'purchase', 'signup') THEN 'always' WHEN level = 'view' AND value > 10 THEN 'extended' END AS mode FROM logs) WHERE mode IS NOT NULL",
    "p02_log_filter": f"{L} SELECT id, level, thread_id FROM logs WHERE upper(level) IN ('ERROR', 'VIEW', 'CLICK') AND ts >= TIMESTAMP '2024-01-03 00:00:00' AND (message ILIKE '%K\": 1%' OR message ILIKE '%k\": 7%') AND ((thread_id < 4000 AND thread_id % 3 = 0) OR thread_id IS NULL) AND id > 100 AND instr(message, 'k') > 0",
    "p03_thread_filter": f"{T} SELECT id, owner, updated FROM thread WHERE status <> 'P' AND price > 1000 AND owner % 2 = 1 AND provider IN ('1-URGENT', '2-HIGH')",
    "p04_provider_match": f"{T} SELECT provider, count(*) AS n FROM thread WHERE coalesce(provider, 'default') IN ('default', '1-URGENT') GROUP BY 1",
    "p05_split_filter": "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'O' AND length(regexp_replace(o_orderpriority, '[^A-Z]', '', 'g')) > 4 GROUP BY 1",
    "a01_over_cap": f"{L} SELECT thread_id, CAST(sum(estimated_bytes) AS BIGINT) AS total_bytes FROM logs WHERE thread_id IS NOT NULL GROUP BY 1 HAVING sum(estimated_bytes) > 300",
    "a02_null_partition_sum": f"{L} SELECT CAST(coalesce(sum(estimated_bytes), 0) AS BIGINT) AS total_bytes FROM logs WHERE thread_id IS NULL AND process_id IS NULL",
    "a03_max_id": f"{L} SELECT level, coalesce(max(CASE WHEN thread_id IS NULL THEN id END), 0) AS max_id FROM logs GROUP BY 1",
    "a04_leases": f"{T}, live AS (SELECT owner, count(*) AS live FROM thread WHERE status = 'P' GROUP BY 1) SELECT id, owner FROM (SELECT id, owner, row_number() OVER (PARTITION BY owner ORDER BY updated, id) AS rn FROM thread WHERE status = 'O') w LEFT JOIN live USING (owner) WHERE rn <= 8 - coalesce(live, 0)",
    "a05_watermark": f"{T} SELECT owner, greatest(coalesce(max(updated), 820454400), 820454400) AS watermark FROM thread WHERE status = 'F' GROUP BY 1",
    "a15_batch_outcomes": f"{T} SELECT CAST(id // 200 AS BIGINT) AS batch, count(*) FILTER (status = 'F') AS done, count(*) FILTER (status <> 'F') AS failed FROM thread GROUP BY 1",
    "a16_distinct_ids": f"{L} SELECT DISTINCT thread_id FROM logs WHERE thread_id IS NOT NULL",
    "w01_thread_budget": f"{L} SELECT id FROM (SELECT id, {RUNNING.format('thread_id')} AS r FROM logs WHERE thread_id IS NOT NULL) WHERE r <= 120",
    "w02_process_budget": f"{L} SELECT id FROM (SELECT id, {RUNNING.format('process_id')} AS r FROM logs WHERE thread_id IS NULL AND process_id IS NOT NULL) WHERE r <= 4000",
    "w03_null_process_budget": f"{L} SELECT id, process_id FROM (SELECT id, process_id, {RUNNING.format('process_id')} AS r FROM logs WHERE thread_id IS NULL) WHERE r <= 2000",
    "j08_stale": f"{T}, {STAGE_SQL}, jobs AS (SELECT doc_id AS id, quality AS ok FROM labels WHERE toxic = 0) SELECT id, updated, shipped, ok FROM thread LEFT JOIN stage USING (id) LEFT JOIN jobs USING (id) WHERE coalesce(shipped, -1) < updated AND coalesce(ok, -1) < 1",
    "j09_outputs_with_owner": f"{T}, {STAGE_SQL} SELECT id, owner, lines, shipped FROM stage LEFT JOIN thread USING (id) WHERE length(trim(coalesce(provider, ''))) > 0 OR lines > 3 ORDER BY shipped DESC, id DESC LIMIT 500",
    "x09_candidates": f"{T}, {STAGE_SQL}, s AS (SELECT * FROM thread WHERE updated BETWEEN 725846400 AND 883612800 ORDER BY updated DESC, id DESC LIMIT 5000) SELECT id, updated FROM s LEFT JOIN stage USING (id) WHERE coalesce(shipped, -1) < updated + 5000000 ORDER BY updated DESC, id DESC LIMIT 64",
    "o01_keyset_page": f"{T} SELECT id, updated, status FROM thread WHERE updated < 883612800 OR (updated = 883612800 AND id < 500) ORDER BY updated DESC, id DESC LIMIT 101",
    "o02_created_page": f"{T}, c AS (SELECT id, updated - (id % 30) * 86400 AS created FROM thread) SELECT id, created FROM c WHERE created < 883612800 OR (created = 883612800 AND id < 500) ORDER BY created DESC, id DESC LIMIT 51",
    "o03_cursor": f"{T} SELECT id, strftime(make_timestamp(updated * 1000000), '%Y-%m-%dT%H:%M:%SZ') || '|' || id AS cursor, updated AS ts, id AS key FROM thread",
    "o05_ids_only": f"{T} SELECT id FROM thread WHERE status = 'F' ORDER BY updated DESC, id DESC LIMIT 26",
    "o06_offset_page": f"{T} SELECT id, owner FROM thread ORDER BY id LIMIT 25 OFFSET 100",
    "o07_log_order": f"{L} SELECT id, message FROM logs WHERE level = 'error' ORDER BY id DESC LIMIT 200",
    "o08_top_k": f"{L} SELECT id, value FROM logs ORDER BY value DESC, id LIMIT 20",
    "u01_union_roots": f"{T} SELECT status = 'F' AS archived, owner, count(*) AS n FROM thread GROUP BY 1, 2",
    "u02_distinct_sorted": "SELECT DISTINCT p_brand, p_type FROM part",
    "x15_recent_buffer": f"{L} SELECT id, level, total FROM (SELECT id, level, count(*) OVER (PARTITION BY level) AS total, row_number() OVER (PARTITION BY level ORDER BY ts DESC, id DESC) AS rn FROM logs) WHERE rn <= 20",
}
