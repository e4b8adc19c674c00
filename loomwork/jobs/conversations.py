"""Conversation queries."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwork.functions import text as tx
from loomwork.operators import conversation as cv
from loomwork.sources.tables import table


def _items(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")


def s11_head_summary(spark, sf):
    """The first user message of the first 10 items, or of 200 more where these have none, and how many items were looked at."""
    user = F.when(F.col("role") == "user", F.col("turn"))
    in_order = W.partitionBy("conv_id").orderBy("turn")
    head = _items(spark, sf).withColumn("rn", F.row_number().over(in_order)).where("rn <= 210")
    before = F.min(user).over(in_order.rowsBetween(W.unboundedPreceding, -1))
    head = head.withColumn("found", before).where("rn <= 10 or found is null")
    return head.groupBy("conv_id").agg(F.min(user).alias("first_user"), F.min_by("text", user).alias("preview"), F.count("*").alias("items"))


def s12_last_entry(spark, sf):
    return _items(spark, sf).groupBy("conv_id").agg(F.max_by("role", "turn").alias("role"), F.max("turn").alias("turn"))


def s13_history_lookup(spark, sf):
    """Item 3 (from 0) of each conversation, and the number of items."""
    w = W.partitionBy("conv_id")
    x = _items(spark, sf).select("conv_id", "turn", "role", F.count("*").over(w).alias("n"), F.row_number().over(w.orderBy("turn")).alias("rn"))
    return x.where("rn = 4").select("conv_id", "turn", "role", "n")


def j10_missing_replies(spark, sf):
    return cv.add_missing_replies(_items(spark, sf), "conv_id", "turn", "role", "text").select("conv_id", "turn", "role", F.length("text").alias("len"))


def j11_orphan_replies(spark, sf):
    return cv.drop_orphan_replies(_items(spark, sf).where("role <> 'user' or length(text) > 120"), "conv_id", "turn", "role").select("conv_id", "turn", "role")


def j12_remove_counterpart(spark, sf):
    """Removes the first assistant item after item 0 of every conversation, with item 0."""
    x = _items(spark, sf)
    first = x.where("role = 'assistant'").groupBy("conv_id").agg(F.min("turn").alias("gone"))
    return x.join(first, "conv_id", "left").where("turn > 0 and not (turn <=> gone)").select("conv_id", "turn", "role")


def _calls(spark, sf):
    """Order lines as items: calls and outputs of an order, with ids of their own."""
    kind = F.element_at(F.array(*[F.lit(x) for x in KINDS]), (F.col("l_suppkey") % 6 + 1).cast("int"))
    x = table(spark, sf, "lineitem")
    return x.select(F.col("l_orderkey").alias("conv_id"), (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("ord"), kind.alias("kind"), F.when(F.col("l_partkey") % 7 != 0, F.col("l_partkey") % 2).alias("call_id")).distinct()


def j10_outputs_by_id(spark, sf):
    return cv.add_missing_outputs(_calls(spark, sf), "conv_id", "ord", "kind", "call_id")


def j11_orphans_by_id(spark, sf):
    return cv.drop_orphan_outputs(_calls(spark, sf), "conv_id", "kind", "call_id")


def j12_counterparts_by_id(spark, sf):
    """The first item of every order goes, and with it its other end."""
    x = _calls(spark, sf)
    first = x.groupBy("conv_id").agg(F.min_by(F.struct("ord", "kind", "call_id"), "ord").alias("i")).select("conv_id", "i.*")
    left = x.join(first.select("conv_id", "ord"), ["conv_id", "ord"], "left_anti")
    return cv.drop_counterparts(left, first, "conv_id", "ord", "kind", "call_id")


def j13_latest_names(spark, sf):
    """The latest user message of the conversations asked for."""
    asked = table(spark, sf, "labels").select(F.col("doc_id").alias("conv_id")).distinct()
    return _items(spark, sf).where("role = 'user'").join(asked, "conv_id", "left_semi").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))


def w04_newest_within_budget(spark, sf):
    x = _items(spark, sf).where("role = 'user'").withColumn("cost", tx.tokens(F.col("text")))
    return cv.select_newest(x, "conv_id", "turn", "cost", 150).select("conv_id", "turn", "cost", "taken")


def w05_items_within_budget(spark, sf):
    """Items in order while they fit in 1,200 bytes; how many were left out."""
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    x = _items(spark, sf).withColumn("running", F.sum(F.octet_length("text").cast("long")).over(w))
    return x.groupBy("conv_id").agg(F.count_if(F.col("running") <= 1200).alias("kept"), F.count_if(F.col("running") > 1200).alias("omitted"))


def x10_session_fold(spark, sf):
    user = F.when(F.col("role") == "user", F.col("turn"))
    return _items(spark, sf).groupBy("conv_id").agg(F.min_by("text", user).alias("title"), F.max("turn").alias("last_turn"), F.max_by("role", "turn").alias("last_role"), F.count_if(F.col("role") == "system").alias("metas"))


def x11_turns(spark, sf):
    x = cv.turns(_items(spark, sf), "conv_id", "turn", "role")
    return x.groupBy("conv_id", "turn_no").agg(F.count("*").alias("items"), F.min("turn").alias("first"), F.max("turn").alias("last"))


def x12_roll_back(spark, sf):
    """Items whose text has a length divisible by 7 count as marks that take back two turns."""
    x = _items(spark, sf).select("conv_id", "turn", F.when(F.length("text") % 7 == 0, "rollback").otherwise("turn").alias("kind"), F.lit(2).alias("n"))
    return cv.roll_back(x, "conv_id", "turn", "kind", "n")


def t19_head_tail_buffer(spark, sf):
    """What a buffer of 600 bytes keeps of each conversation's texts, piece by piece."""
    x = _items(spark, sf).select("conv_id", "turn", F.col("text").cast("binary").alias("data"))
    return cv.head_tail(x, "conv_id", "turn", "data", 600).select("conv_id", "turn", "part", F.octet_length("data").cast("long").alias("bytes"), F.md5(F.hex("data").cast("binary")).alias("digest"))


def x13_merge_deltas(spark, sf):
    parts = F.sort_array(F.collect_list(F.struct("turn", "text")))
    return _items(spark, sf).where("role = 'assistant'").groupBy("conv_id").agg(parts.alias("parts")).select("conv_id", F.md5(F.array_join(F.transform("parts", lambda p: p["text"]), "")).alias("digest"))


def a06_outcomes(spark, sf):
    cost = tx.tokens(F.col("text"))
    return _items(spark, sf).groupBy("turn").agg(*[F.count_if(F.col("role") == r).alias(r) for r in ("user", "assistant", "system")], F.sum(F.when(F.col("role") == "assistant", cost)).alias("output_tokens"))


def a07_running_usage(spark, sf):
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    cost = tx.tokens(F.col("text"))
    return _items(spark, sf).select("conv_id", "turn", F.sum(F.when(F.col("role") != "assistant", cost).otherwise(0)).over(w).alias("input"), F.sum(F.when(F.col("role") == "assistant", cost).otherwise(0)).over(w).alias("output"), cost.alias("last"))


def a08_context_estimate(spark, sf):
    n = F.octet_length("text").cast("long")
    cost = F.when(F.col("role") == "assistant", F.greatest(F.floor(n * 3 / 4) - 650, F.lit(0))).otherwise(F.ceil(n / 4))
    return _items(spark, sf).groupBy("conv_id").agg((F.sum(cost) + 100).alias("estimate"))


def a09_after_last_reply(spark, sf):
    w = W.partitionBy("conv_id")
    x = _items(spark, sf).withColumn("reply", F.max(F.when(F.col("role") == "assistant", F.col("turn"))).over(w)).withColumn("asked", F.max(F.when(F.col("role") == "user", F.col("turn"))).over(w))
    cost = tx.tokens(F.col("text"))
    return x.groupBy("conv_id").agg(F.sum(F.when(F.col("turn") > F.coalesce("reply", F.lit(2**31)), cost).otherwise(0)).alias("after_reply"), F.sum(F.when((F.col("turn") < F.col("asked")) & (F.col("role") == "assistant"), cost).otherwise(0)).alias("earlier"))


def a10_metric_sums(spark, sf):
    e = table(spark, sf, "events")
    clean = F.when(F.isnan("value") | (F.col("value") < 0), 0.0).otherwise(F.col("value"))
    return e.groupBy("event_type").agg(F.count("*").alias("counter"), F.round(F.sum(clean), 2).alias("total"))


def a11_merge_summaries(spark, sf):
    """Counts add up; a gauge keeps its last value that isn't 0."""
    e = table(spark, sf, "events").withColumn("gauge", F.floor("value") % 3)
    return e.groupBy("user_id").agg(F.count("*").alias("n"), F.max_by("gauge", F.when(F.col("gauge") != 0, F.col("event_id"))).alias("gauge"))


def a12_usage_kinds(spark, sf):
    kind = F.when(F.contains("url", F.lit("/en/")), "en").when(F.contains("url", F.lit("/fr/")), "fr").when(F.contains("url", F.lit("?page=")), "paged")
    return table(spark, sf, "pages").groupBy(kind.alias("kind"), (F.length("html") > 1500).alias("large")).agg(F.count("*").alias("n")).where("kind is not null")


KINDS = ("function_call", "function_output", "custom_call", "custom_output", "shell_call", "message")
QUERIES = {n: f for n, f in list(globals().items()) if n[:1] in "sjwxat" and n[1:3].isdigit()}
C = "conversations"
TOK = "CAST(ceil(strlen(text) / 4) AS BIGINT)"
CALLS = f"""c AS (SELECT DISTINCT l_orderkey AS conv_id, l_linenumber * 1000000 + l_partkey AS ord, ({list(KINDS)})[l_suppkey % 6 + 1] AS kind, CASE WHEN l_partkey % 7 <> 0 THEN l_partkey % 2 END AS call_id FROM lineitem),
  q AS (SELECT *, CASE kind WHEN 'function_call' THEN 'function_output' WHEN 'shell_call' THEN 'function_output' WHEN 'custom_call' THEN 'custom_output' END AS want FROM c)"""
ORACLES = {
    "t19_head_tail_buffer": """WITH c AS (SELECT conv_id, turn, hex(encode(text)) AS h, strlen(text) AS n FROM conversations), b AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS hi, sum(n) OVER (PARTITION BY conv_id) AS total FROM c),
      p AS (SELECT conv_id, turn, 'head' AS part, substr(h, 1, CAST(2 * (least(hi, 300) - (hi - n)) AS BIGINT)) AS h FROM b WHERE n > 0 AND hi - n < 300
        UNION ALL SELECT conv_id, turn, 'tail', substr(h, CAST(2 * (greatest(hi - n, 300, total - 300) - (hi - n)) + 1 AS BIGINT)) FROM b WHERE n > 0 AND hi > greatest(300, total - 300))
      SELECT conv_id, turn, part, CAST(length(h) / 2 AS BIGINT) AS bytes, md5(h) AS digest FROM p""",
    "x12_roll_back": """WITH e AS (SELECT conv_id, turn, length(text) % 7 = 0 AS back FROM conversations),
      s AS (SELECT *, sum(CASE WHEN back THEN -2 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS s FROM e), d AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY conv_id ORDER BY turn)) AS depth FROM s)
      SELECT conv_id, turn FROM d a WHERE NOT back AND NOT EXISTS (SELECT 1 FROM d b WHERE b.conv_id = a.conv_id AND b.turn > a.turn AND b.depth < a.depth)""",
    "j10_outputs_by_id": f"""WITH {CALLS} SELECT conv_id, ord::DOUBLE AS ord, kind, call_id, false AS aborted FROM c UNION ALL SELECT conv_id, ord + 0.5::DOUBLE, want, call_id, true FROM q
      WHERE want IS NOT NULL AND call_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM c WHERE c.conv_id = q.conv_id AND c.kind = q.want AND c.call_id = q.call_id)""",
    "j11_orphans_by_id": f"WITH {CALLS} SELECT conv_id, ord, kind, call_id FROM c WHERE kind NOT LIKE '%output' OR EXISTS (SELECT 1 FROM q WHERE q.conv_id = c.conv_id AND q.want = c.kind AND q.call_id = c.call_id)",
    "j12_counterparts_by_id": f"""WITH {CALLS}, f AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY ord) = 1), l AS (SELECT * FROM q ANTI JOIN f USING (conv_id, ord)),
      m AS (SELECT l.conv_id, l.ord, row_number() OVER (PARTITION BY l.conv_id ORDER BY l.kind = 'shell_call', l.ord) AS rn FROM l JOIN f ON f.conv_id = l.conv_id AND f.call_id = l.call_id AND (f.want = l.kind OR l.want = f.kind))
      SELECT conv_id, ord, kind, call_id FROM l ANTI JOIN (SELECT * FROM m WHERE rn = 1) USING (conv_id, ord)""",
    "s11_head_summary": f"WITH h AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn, min(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS found FROM {C}) SELECT conv_id, min(CASE WHEN role = 'user' THEN turn END) AS first_user, arg_min(text, CASE WHEN role = 'user' THEN turn END) AS preview, count(*) AS items FROM h WHERE rn <= 10 OR (rn <= 210 AND found IS NULL) GROUP BY 1",
    "s12_last_entry": f"SELECT conv_id, arg_max(role, turn) AS role, max(turn) AS turn FROM {C} GROUP BY 1",
    "s13_history_lookup": f"SELECT conv_id, turn, role, n FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM {C}) WHERE rn = 4",
    "j10_missing_replies": f"WITH x AS (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM {C}) SELECT conv_id, turn::DOUBLE AS turn, role, length(text) AS len FROM {C} UNION ALL SELECT conv_id, turn + 0.5::DOUBLE, 'assistant', 7 FROM x WHERE role = 'user' AND nxt IS DISTINCT FROM 'assistant'",
    "j11_orphan_replies": f"WITH x AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prv FROM {C} WHERE role <> 'user' OR length(text) > 120) SELECT conv_id, turn, role FROM x WHERE role <> 'assistant' OR prv IS NOT DISTINCT FROM 'user'",
    "j12_remove_counterpart": f"WITH f AS (SELECT conv_id, min(turn) AS gone FROM {C} WHERE role = 'assistant' GROUP BY 1) SELECT conv_id, turn, role FROM {C} LEFT JOIN f USING (conv_id) WHERE turn > 0 AND turn IS DISTINCT FROM gone",
    "j13_latest_names": f"SELECT conv_id, arg_max(text, turn) AS text FROM {C} WHERE role = 'user' AND conv_id IN (SELECT doc_id FROM labels) GROUP BY 1",
    "w04_newest_within_budget": f"WITH x AS (SELECT conv_id, turn, {TOK} AS cost FROM {C} WHERE role = 'user'), b AS (SELECT *, coalesce(sum(cost) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM x) SELECT conv_id, turn, cost, CAST(least(cost, 150 - before) AS BIGINT) AS taken FROM b WHERE before < 150",
    "w05_items_within_budget": f"WITH x AS (SELECT conv_id, sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS r FROM {C}) SELECT conv_id, count(*) FILTER (r <= 1200) AS kept, count(*) FILTER (r > 1200) AS omitted FROM x GROUP BY 1",
    "x10_session_fold": f"SELECT conv_id, arg_min(text, CASE WHEN role = 'user' THEN turn END) AS title, max(turn) AS last_turn, arg_max(role, turn) AS last_role, count(*) FILTER (role = 'system') AS metas FROM {C} GROUP BY 1",
    "x11_turns": f"WITH x AS (SELECT *, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS turn_no FROM {C}) SELECT conv_id, turn_no, count(*) AS items, min(turn) AS first, max(turn) AS last FROM x GROUP BY 1, 2",
    "x13_merge_deltas": f"SELECT conv_id, md5(string_agg(text, '' ORDER BY turn, text)) AS digest FROM {C} WHERE role = 'assistant' GROUP BY 1",
    "a06_outcomes": f"SELECT turn, count(*) FILTER (role = 'user') AS user, count(*) FILTER (role = 'assistant') AS assistant, count(*) FILTER (role = 'system') AS system, CAST(sum({TOK}) FILTER (role = 'assistant') AS BIGINT) AS output_tokens FROM {C} GROUP BY 1",
    "a07_running_usage": f"SELECT conv_id, turn, CAST(sum(CASE WHEN role <> 'assistant' THEN {TOK} ELSE 0 END) OVER w AS BIGINT) AS input, CAST(sum(CASE WHEN role = 'assistant' THEN {TOK} ELSE 0 END) OVER w AS BIGINT) AS output, {TOK} AS last FROM {C} WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)",
    "a08_context_estimate": f"SELECT conv_id, CAST(sum(CASE WHEN role = 'assistant' THEN greatest(floor(strlen(text) * 3 / 4) - 650, 0) ELSE ceil(strlen(text) / 4) END) + 100 AS BIGINT) AS estimate FROM {C} GROUP BY 1",
    "a09_after_last_reply": f"WITH x AS (SELECT *, max(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id) AS reply, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS asked FROM {C}) SELECT conv_id, CAST(sum(CASE WHEN turn > coalesce(reply, 2147483648) THEN {TOK} ELSE 0 END) AS BIGINT) AS after_reply, CAST(sum(CASE WHEN turn < asked AND role = 'assistant' THEN {TOK} ELSE 0 END) AS BIGINT) AS earlier FROM x GROUP BY 1",
    "a10_metric_sums": "SELECT event_type, count(*) AS counter, round(sum(CASE WHEN isnan(value) OR value < 0 THEN 0 ELSE value END), 2) AS total FROM events GROUP BY 1",
    "a11_merge_summaries": "WITH e AS (SELECT *, CAST(floor(value) AS BIGINT) % 3 AS gauge FROM events) SELECT user_id, count(*) AS n, arg_max(gauge, CASE WHEN gauge <> 0 THEN event_id END) AS gauge FROM e GROUP BY 1",
    "a12_usage_kinds": "SELECT CASE WHEN contains(url, '/en/') THEN 'en' WHEN contains(url, '/fr/') THEN 'fr' WHEN contains(url, '?page=') THEN 'paged' END AS kind, length(html) > 1500 AS large, count(*) AS n FROM pages GROUP BY 1, 2 HAVING kind IS NOT NULL",
}
