"""Scalar and policy queries (S03, S09, S15, S17, E04, E05, E07, E10, P01, T, A13, A14, J14-J17, N)."""

import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.functions import commands, policy
from loomwork.functions import text as tx
from loomwork.operators import events
from loomwork.sources.tables import table

#: Extensions of the languages.
LANGUAGES = {
    "py": "python", "pyi": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx", "jsx": "tsx",
    "rs": "rust", "go": "go", "java": "java", "c": "c", "h": "cpp", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "hxx": "cpp",
}


def _docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


def _paths(spark, sf):
    """Parts as source paths: src/<brand>/<name>.<extension>."""
    ext = F.element_at(F.array(*[F.lit(x) for x in ("py", "rs", "h", "jsx", "md")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", F.concat(F.lit("src/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.lit("/"), F.when(F.col("p_partkey") % 10 == 0, "__init__").otherwise(F.replace("p_name", F.lit(" "), F.lit("_"))), F.lit("."), ext).alias("path"))


PATH_SQL = "p AS (SELECT p_partkey, 'src/' || lower(replace(p_brand, '#', '')) || '/' || CASE WHEN p_partkey % 10 = 0 THEN '__init__' ELSE replace(p_name, ' ', '_') END || '.' || (['py','rs','h','jsx','md'])[p_partkey % 5 + 1] AS path FROM part)"


def s03_language(spark, sf):
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return _paths(spark, sf).select("p_partkey", F.try_element_at(known, F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))).alias("language"))


def s09_parse_name(spark, sf):
    """Name to time and id: the id is what follows the fifth '-' of the time."""
    name = F.concat(F.lit("rollout-"), F.date_format("ts", "yyyy-MM-dd'T'HH-mm-ss"), F.lit("-"), F.format_string("%08d", "event_id"))
    x = table(spark, sf, "events").select("event_id", name.alias("name"))
    at = r"^rollout-(\d{4}-\d{2}-\d{2})T(\d{2})-(\d{2})-(\d{2})-(.+)$"
    stamp = F.to_timestamp(F.regexp_replace("name", at, "$1 $2:$3:$4"), "yyyy-MM-dd HH:mm:ss")
    return x.select("event_id", F.unix_timestamp(stamp).alias("ts"), F.regexp_extract("name", at, 5).alias("key"))


def s15_line_slice(spark, sf):
    """Lines 2 to 6 of every text, numbered, each cut to 500 bytes at a character's end."""
    x = _docs(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line")).where("n between 1 and 5")
    return x.select("doc_id", F.concat(F.lit("L"), (F.col("n") + 1).cast("string"), F.lit(": "), tx.left_bytes(F.regexp_replace("line", "\r$", ""), 500)).alias("line"))


def s16_indent_block(spark, sf):
    """Effective indents of page lines: blank lines take over the last one; lines at least as deep as the page's first."""
    x = table(spark, sf, "pages").select("page_id", F.posexplode(F.split(F.replace("html", F.lit("<"), F.lit("\n\t<")), "\n")).alias("n", "line"))
    own = F.when(F.trim("line") != "", tx.indent(F.col("line")))
    w = W.partitionBy("page_id").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    return x.select("page_id", "n", F.last(own, ignorenulls=True).over(w).alias("indent"))


def s17_regex_search(spark, sf):
    return _docs(spark, sf).where(F.col("text").rlike(r"\d{3}-\d{4}")).orderBy(F.desc("doc_id")).limit(100).select("doc_id")


def e04_element_id(spark, sf):
    return _paths(spark, sf).select("p_partkey", F.concat(F.lit("file_"), F.substring(F.sha2(F.concat_ws("/", F.lit("file"), "path"), 256), 1, 16)).alias("id"))


def e05_module_path(spark, sf):
    m = F.regexp_replace(F.replace(F.regexp_replace(F.regexp_replace("path", "^src/", ""), r"\.(py|ts|js|rs|go|java)$", ""), F.lit("/"), F.lit(".")), r"\.__init__$", "")
    return _paths(spark, sf).select("p_partkey", m.alias("module"))


def e07_builtin_filter(spark, sf):
    """Words less those of a stop set, an anti-join: here the words of benchmark passages."""
    words = _docs(spark, sf).select(F.explode(F.split(F.lower("text"), r"[^a-z]+")).alias("w")).where("w <> ''").groupBy("w").agg(F.count("*").alias("n"))
    stop = table(spark, sf, "benchmark").select(F.explode(F.split(F.lower("text"), r"[^a-z]+")).alias("w")).distinct()
    return words.join(stop, "w", "left_anti")


def e10_global_index(spark, sf):
    """Exports: symbol, file and id of everything but files."""
    return _paths(spark, sf).where(~F.contains("path", F.lit("__init__"))).select(F.regexp_extract("path", r"([^/]+)\.[^.]*$", 1).alias("symbol"), "path").groupBy("symbol").agg(F.count("*").alias("n"), F.min("path").alias("first"))


def p01_node_kinds(spark, sf):
    kind = F.when(F.col("p_type") == "ECONOMY", "Class").when(F.col("p_type") == "STANDARD", "Function").when(F.col("p_type").isin("PROMO", "LARGE"), "Module").otherwise("File")
    return table(spark, sf, "part").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def t01_truncate(spark, sf):
    return _docs(spark, sf).select("doc_id", tx.truncated("text", 64).alias("text"))


def t02_token_estimate(spark, sf):
    return _docs(spark, sf).select("doc_id", tx.tokens(F.col("text")).alias("tokens"), (tx.tokens(F.col("text")) * 4).alias("bytes"))


def t03_truncate_report(spark, sf):
    lines = F.size(F.split("text", "\n"))
    return _docs(spark, sf).select("doc_id", F.when(F.octet_length("text") > 64, F.concat(F.lit("Total output lines: "), lines.cast("string"), F.lit("\n\n"), tx.truncated("text", 64, "tokens"))).otherwise(F.col("text")).alias("text"))


def t04_redact(spark, sf):
    x = _docs(spark, sf).select("doc_id", "text", tx.redact(F.col("text")).alias("clean"))
    return x.where("text <> clean").select("doc_id", F.md5("clean").alias("digest"))


def _hosts(spark, sf):
    raw = F.when(F.col("page_id") % 3 == 0, F.concat(F.upper(tx.host(F.col("url"))), F.lit(":8080"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit(" "), tx.host(F.col("url")), F.lit(".. "))).otherwise(F.concat(F.lit("[::"), F.col("page_id").cast("string"), F.lit("]:1")))
    return table(spark, sf, "pages").select("page_id", raw.alias("raw"))


def t05_normal_host(spark, sf):
    return _hosts(spark, sf).select("page_id", tx.normal_host(F.col("raw")).alias("host"))


def t06_private_address(spark, sf):
    """Addresses made of customer keys: four of five IPv4, the others IPv6 or this machine's name."""
    k = F.col("c_custkey")
    x = table(spark, sf, "customer").select("c_custkey", F.element_at(F.array(*[F.lit(n) for n in (10, 127, 172, 192, 100, 8)]), (k % 6 + 1).cast("int")).alias("a"), (k % 256).alias("b"))
    dotted = F.format_string("%d.%d.1.1", "a", "b")
    other = F.array(F.lit("::1"), F.concat(F.lit("fc00::"), F.col("b").cast("string")), F.lit("fe80::1%eth0"), F.concat(F.lit("2001:db8::"), F.col("b").cast("string")), F.concat(F.lit("::ffff:10.0.0."), F.col("b").cast("string")), F.lit("localhost"))
    host = F.when(k % 5 > 0, dotted).otherwise(F.element_at(other, (F.floor(k / 5) % 6 + 1).cast("int")))
    return x.select("c_custkey", policy.non_public(host).alias("private"))


def t07_user_message(spark, sf):
    """What follows the first ':' trimmed, or the whole trimmed."""
    t = F.col("text")
    return _docs(spark, sf).select("doc_id", F.when(F.instr(t, ":") > 0, F.trim(F.expr("substring(text, instr(text, ':') + 1)"))).otherwise(F.trim(t)).alias("message")).select("doc_id", F.md5("message").alias("digest"))


def t07_previews(spark, sf):
    """Previews of user messages, some behind a heading, some empty, every other with images."""
    turn = F.col("turn")
    text = F.when(turn % 3 == 0, F.concat(F.lit("context\n## My request: "), "text", F.lit(" \n"))).when(turn % 3 == 1, F.lit(" \n ")).otherwise(F.concat(F.lit("\t"), "text"))
    x = table(spark, sf, "conversations").select("conv_id", "turn", text.alias("text"))
    return x.select("conv_id", "turn", F.md5(tx.user_message(F.col("text"), "## My request:", F.col("conv_id") % 2 == 0)).alias("digest"))


def t08_timestamps(spark, sf):
    """Two text forms of a time, read back to the second."""
    e = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH-mm-ss")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("s"))
    return e.select("event_id", F.unix_timestamp(F.coalesce(F.try_to_timestamp("s", F.lit("yyyy-MM-dd'T'HH-mm-ss")), F.try_to_timestamp("s", F.lit("yyyy-MM-dd'T'HH:mm:ssX")))).alias("ts"))


def t09_time_argument(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.unix_timestamp("ts").cast("string")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("s"))
    return e.select("event_id", F.coalesce(F.col("s").try_cast("bigint"), F.unix_timestamp(F.try_to_timestamp("s"))).alias("ts"))


def t10_normal_path(spark, sf):
    return _paths(spark, sf).select("p_partkey", F.regexp_replace(F.replace(F.concat(F.replace("path", F.lit("/"), F.lit("\\")), F.lit("//")), F.lit("\\"), F.lit("/")), "/+$", "").alias("path"))


def t11_join_parts(spark, sf):
    parts = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    return _docs(spark, sf).select("doc_id", F.md5(F.nullif(F.array_join(parts, "\n"), F.lit(""))).alias("digest"))


def t12_json_keys(spark, sf):
    return table(spark, sf, "events").select(F.explode(F.json_object_keys("props")).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def t13_json_coerce(spark, sf):
    """First of several keys of a JSON text."""
    j = lambda k: F.get_json_object("props", f"$.{k}")
    return table(spark, sf, "events").select("event_id", F.coalesce(j("content"), j("text"), j("k")).cast("bigint").alias("value"))


def t14_context_left(spark, sf):
    window, used = 128_000, F.col("n_chars") * 4
    left = F.greatest(F.lit(window - 12_000) - F.greatest(used - 12_000, F.lit(0)), F.lit(0)) / (window - 12_000) * 100
    return table(spark, sf, "documents").select("doc_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), left))).cast("bigint").alias("percent"))


def t15_derived_usage(spark, sf):
    line = table(spark, sf, "lineitem")
    cached, total = F.floor(F.col("l_quantity") * F.col("l_discount") * 10), F.floor("l_quantity")
    return line.groupBy("l_returnflag").agg(F.sum(F.greatest(total - cached, F.lit(0))).alias("non_cached"), F.sum(F.greatest(cached, F.lit(0))).alias("cached"))


@F.pandas_udf(T.IntegerType())
def _seek(text: pd.Series) -> pd.Series:
    return pd.Series([tx.seek_lines(lines := t.split("\n"), [x.strip() + " " for x in lines[1:3]]) for t in text], dtype="Int32")


def t16_seek_lines(spark, sf):
    """Place of a text's own second and third line, blanks apart."""
    return _docs(spark, sf).select("doc_id", _seek(F.coalesce("text", F.lit(""))).alias("at"))


def t17_indent(spark, sf):
    x = _docs(spark, sf).select("doc_id", F.concat(F.repeat(F.lit("\t"), (F.col("doc_id") % 3).cast("int")), F.repeat(F.lit(" "), (F.col("doc_id") % 5).cast("int")), F.lit("x")).alias("line"))
    return x.select("doc_id", tx.indent(F.col("line")).alias("indent"))


def t18_sha1(spark, sf):
    blob = F.concat(F.lit("blob "), F.octet_length("text").cast("string"), F.decode(F.lit(bytearray(b"\0")), "utf-8"), F.col("text"))
    return _docs(spark, sf).select("doc_id", F.sha1("text").alias("digest"), F.sha1(blob).alias("blob_id"))


def t19_head_tail(spark, sf):
    return _docs(spark, sf).select("doc_id", F.when(F.length("text") > 40, F.concat(F.left("text", F.lit(20)), F.right("text", F.lit(20)))).otherwise(F.col("text")).alias("kept"))


RULES = [("red", [["ring", "gear", "widget"]], 2), ("red", [], 1), ("small", [["ring"]], 0), ("blue", [["gear", "ring"]], 2), ("green", [], 1)]
RULES_SQL = "r(program, alts, severity) AS (VALUES ('red', ['ring','gear','widget'], 2), ('red', NULL, 1), ('small', ['ring'], 0), ('blue', ['gear','ring'], 2), ('green', NULL, 1))"


def _commands(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.split("p_name", " ").alias("argv"))


def _rules(spark):
    return F.broadcast(spark.createDataFrame(RULES, "program string, rest array<array<string>>, severity int"))


def j14_match_rules(spark, sf):
    return policy.match_rules(_commands(spark, sf), _rules(spark)).groupBy("id").agg(F.count("*").alias("rules"), F.max("matched").cast("bigint").alias("longest"))


def a13_decide(spark, sf):
    return policy.decide(_commands(spark, sf), _rules(spark), 1)


def a14_allowed_prefixes(spark, sf):
    return policy.match_rules(_commands(spark, sf), _rules(spark)).where("severity = 0").join(_commands(spark, sf), "id").select(F.array_join(F.slice("argv", 1, F.col("matched")), " ").alias("prefix")).distinct()


def _patterns(spark, sf):
    """Patterns of the hosts themselves: below some, at or below others, some denied."""
    h = table(spark, sf, "pages").select(tx.host(F.col("url")).alias("host"), "page_id")
    kind = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("*."), "host")).when(F.col("page_id") % 3 == 1, F.concat(F.lit("**."), "host")).otherwise(F.col("host"))
    return h.select(kind.alias("pattern"), (F.col("page_id") % 4 == 0).alias("allow")).distinct()


def j15_match_hosts(spark, sf):
    h = table(spark, sf, "pages").select(F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("www."), tx.host(F.col("url")))).otherwise(tx.host(F.col("url"))).alias("host"))
    return policy.match_hosts(h, _patterns(spark, sf))


def j16_contains(spark, sf):
    """Patterns of the first that allow all that the second allows, of one base."""
    p = _patterns(spark, sf).select("pattern").distinct().withColumn("base", F.regexp_replace("pattern", r"^\*{1,2}\.", ""))
    a, b = p.select("base", F.col("pattern").alias("a")), p.select("base", F.col("pattern").alias("b"))
    wide = F.col("a").startswith("**.") | (F.col("a") == F.col("b"))
    return a.join(b, "base").where(wide).select("a", "b")


def j17_longest_prefix(spark, sf):
    roots = _paths(spark, sf).select(F.regexp_replace("path", "/[^/]*$", "").alias("root")).where("root like '%1%'").union(spark.range(1).select(F.lit("src").alias("root")))
    return policy.longest_prefix(_paths(spark, sf).select("path").distinct(), roots)


def n01_session_filter(spark, sf):
    return table(spark, sf, "orders").where((F.col("o_orderstatus") == "O") & (F.instr(F.lower("o_orderpriority"), "urg") > 0)).select("o_orderkey")


def n03_commit_rows(spark, sf):
    """Records of three fields split at US; short ones are left out."""
    us = "\x1f"
    row = F.when(F.col("event_id") % 11 == 0, F.lit("bad")).otherwise(F.concat_ws(us, F.col("event_id").cast("string"), F.unix_timestamp("ts").cast("string"), "event_type"))
    x = table(spark, sf, "events").select(F.split(row, us).alias("f")).where("size(f) = 3")
    return x.select(F.col("f")[0].cast("bigint").alias("id"), F.col("f")[1].cast("bigint").alias("ts"), F.col("f")[2].alias("subject"))


def n04_default_first(spark, sf):
    b = table(spark, sf, "part").select("p_brand").distinct()
    return b.select("p_brand", F.row_number().over(W.orderBy(F.col("p_brand") != "Brand#9", "p_brand")).alias("place"))


def n05_collapse_repeats(spark, sf):
    """Consecutive equal events of a user once."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf, "events").withColumn("last", F.lag("event_type").over(w)).where("not (last <=> event_type)").select("event_id", "event_type")


def n06_word_commands(spark, sf):
    """Command lines as lists of words, one row for each command of a list; lines with redirections, substitutions, groups or open quotes give none.

    The lines are made of events: words, quoted words, ``&&``, ``||``, ``;`` and ``|`` between commands.
    """
    e = table(spark, sf, "events")
    k = F.col("event_id")
    end = F.element_at(F.array(*[F.lit(x) for x in (" && ls -l", " | head -n 3", "; echo 'a && b'", " > out", " $(pwd)", " || echo \"x y\"", " 'open")]), (k % 7 + 1).cast("int"))
    line = F.concat(F.lit("cat "), "event_type", F.lit("/"), F.col("user_id").cast("string"), end)
    return policy.word_commands(e.select("event_id", line.alias("line")), "event_id", "line")


def _shell_lines(spark, sf):
    """Events as command lines of twelve kinds: event_id, line."""
    forms = ["cd src/%1$s && cat %2$d.py", "cd /a && cd b && sed -n 1,20p %1$s/%2$d.rs | head -n 5", "rg -n -g *.py %1$s src/%2$d/", "ls -la packages/%2$d/src | wc -l", "echo start && cat %1$s && cat %1$s", "grep -e %1$s -m 3 logs/%2$d || true", "wc -l; sort", "find . -name %1$s", "cat %2$d > out", "true && nl -ba && python3 -c 'import os; os.walk(1)'", "head -n 5 %1$s; tail -n +3 %2$d; git ls-files build/", "cd %1$s && make"]
    e, k = table(spark, sf, "events"), F.col("event_id") % 12
    line = F.coalesce(*[F.when(k == i, F.format_string(f, "event_type", "user_id")) for i, f in enumerate(forms)])
    return e.select("event_id", line.alias("line"))


def n05_commands(spark, sf):
    """What command lines do: files read below the folders gone to, lists, searches, others; repeats once."""
    return commands.summaries(_shell_lines(spark, sf), "event_id", "line")


def n08_path_by_id(spark, sf):
    """Path by key where that path exists, else the found one that holds the id, with whether the index is to be repaired."""
    there = _paths(spark, sf).where("p_partkey % 9 <> 0")
    stored = _paths(spark, sf).where("p_partkey % 4 <> 0").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("old/"), "path")).otherwise(F.col("path")).alias("stored"))
    good = stored.join(there.select(F.col("path").alias("stored")).distinct(), "stored", "left_semi").select("p_partkey", F.col("stored").alias("good"))
    x = _paths(spark, sf).select("p_partkey").join(good, "p_partkey", "left").join(there, "p_partkey", "left")
    return x.select("p_partkey", F.coalesce("good", "path").alias("path"), (F.col("good").isNull() & F.col("path").isNotNull()).alias("repaired"))


def n07_pair_events(spark, sf):
    """A view and the next purchase of its user as begin and end of one item."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(1, W.unboundedFollowing)
    e = table(spark, sf, "events").withColumn("end", F.first(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w))
    return e.where("event_type = 'view'").select("event_id", "end")


def n07_items(spark, sf):
    """Events of a user as items: views begin a call, purchases end it, others are complete at once."""
    what = F.when(F.col("event_type") == "view", "begin").when(F.col("event_type") == "purchase", "end").otherwise("message")
    e = table(spark, sf, "events").select("event_id", "ts", "user_id", what.alias("what"), F.when(F.col("event_id") % 7 != 0, F.col("event_id") % 3).alias("call"))
    return events.items(e, "user_id", ["ts", "event_id"], "call", "what", F.date_trunc("day", "ts")).select("event_id", "event", "item", "begun")


QUERIES = {n: f for n, f in list(globals().items()) if n[:1] in "septajn" and n[1:3].isdigit()}
HOST_SQL = "regexp_extract(url, '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1)"
P = f"WITH {PATH_SQL}"
PATTERN_SQL = f"pat AS (SELECT DISTINCT CASE page_id % 3 WHEN 0 THEN '*.' || h WHEN 1 THEN '**.' || h ELSE h END AS pattern, h AS base, page_id % 3 AS how, page_id % 4 = 0 AS allow FROM (SELECT page_id, {HOST_SQL} AS h FROM pages))"
CLEAN_SQL = (
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, 'sk-[A-Za-z0-9]{20,}', '[REDACTED_SECRET]', 'g'), '\\bAKIA[0-9A-Z]{16}\\b', '[REDACTED_SECRET]', 'g'),"
    " '(?i)\\bBearer\\s+[A-Za-z0-9._\\-]{16,}\\b', 'Bearer [REDACTED_SECRET]', 'g'), '(?i)\\b(api[_-]?key|token|secret|password)\\b(\\s*[:=]\\s*)([\"'']?)[^\\s\"'']{8,}', '\\1\\2\\3[REDACTED_SECRET]', 'g')"
)
MATCH_SQL = f"{RULES_SQL}, c AS (SELECT p_partkey AS id, string_split(p_name, ' ') AS argv FROM part), m AS (SELECT id, severity, CASE WHEN alts IS NULL THEN 1 ELSE 2 END AS matched, argv FROM c JOIN r ON argv[1] = program WHERE alts IS NULL OR list_contains(alts, argv[2]))"
ORACLES = {
    "s03_language": f"{P}, l(ext, language) AS (VALUES {', '.join(f"('{k}', '{v}')" for k, v in LANGUAGES.items())}) SELECT p_partkey, language FROM p LEFT JOIN l ON ext = regexp_extract(path, '\\.([^./]+)$', 1)",
    "s09_parse_name": "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts, lpad(CAST(event_id AS VARCHAR), 8, '0') AS key FROM events",
    "s15_line_slice": "SELECT doc_id, 'L' || n || ': ' || list_max(list_transform(range(0, 501), lambda c: CASE WHEN strlen(left(l, c)) <= 500 THEN left(l, c) ELSE '' END)) AS line FROM (SELECT doc_id, n, regexp_replace(line, '\\r$', '') AS l FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents) WHERE n BETWEEN 2 AND 6)",
    "s17_regex_search": "SELECT doc_id FROM documents WHERE regexp_matches(text, '\\d{3}-\\d{4}') ORDER BY doc_id DESC LIMIT 100",
    "e04_element_id": f"{P} SELECT p_partkey, 'file_' || left(sha256('file/' || path), 16) AS id FROM p",
    "e05_module_path": f"{P} SELECT p_partkey, regexp_replace(replace(regexp_replace(regexp_replace(path, '^src/', ''), '\\.(py|ts|js|rs|go|java)$', ''), '/', '.'), '\\.__init__$', '') AS module FROM p",
    "e07_builtin_filter": "WITH w AS (SELECT unnest(string_split_regex(lower(text), '[^a-z]+')) AS w FROM documents), s AS (SELECT unnest(string_split_regex(lower(text), '[^a-z]+')) AS w FROM benchmark) SELECT w, count(*) AS n FROM w WHERE w <> '' AND w NOT IN (SELECT w FROM s) GROUP BY 1",
    "e10_global_index": f"{P} SELECT regexp_extract(path, '([^/]+)\\.[^.]*$', 1) AS symbol, count(*) AS n, min(path) AS first FROM p WHERE NOT contains(path, '__init__') GROUP BY 1",
    "p01_node_kinds": "SELECT CASE WHEN p_type = 'ECONOMY' THEN 'Class' WHEN p_type = 'STANDARD' THEN 'Function' WHEN p_type IN ('PROMO', 'LARGE') THEN 'Module' ELSE 'File' END AS kind, count(*) AS n FROM part GROUP BY 1",
    "t02_token_estimate": "SELECT doc_id, CAST(ceil(strlen(text) / 4) AS BIGINT) AS tokens, CAST(ceil(strlen(text) / 4) * 4 AS BIGINT) AS bytes FROM documents",
    "t04_redact": f"SELECT doc_id, md5(clean) AS digest FROM (SELECT doc_id, text, {CLEAN_SQL} AS clean FROM documents) WHERE text <> clean",
    "t05_normal_host": f"SELECT page_id, CASE WHEN page_id % 3 = 2 THEN '::' || page_id ELSE lower({HOST_SQL}) END AS host FROM pages",
    "t06_private_address": "WITH x AS (SELECT c_custkey, ([10, 127, 172, 192, 100, 8])[c_custkey % 6 + 1] AS a, c_custkey % 256 AS b FROM customer) SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN c_custkey // 5 % 6 <> 3 ELSE a IN (10, 127) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 100 AND b BETWEEN 64 AND 127) END AS private FROM x",
    "t07_user_message": "SELECT doc_id, md5(CASE WHEN instr(text, ':') > 0 THEN trim(substr(text, instr(text, ':') + 1)) ELSE trim(text) END) AS digest FROM documents",
    "t07_previews": """SELECT conv_id, turn, md5(coalesce(nullif(CASE turn % 3 WHEN 1 THEN '' ELSE regexp_replace(text, '^\\s+|\\s+$', '', 'g') END, ''), CASE WHEN conv_id % 2 = 0 THEN '[Image]' END)) AS digest FROM conversations""",
    "t08_timestamps": "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts FROM events",
    "t09_time_argument": "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts FROM events",
    "t10_normal_path": f"{P} SELECT p_partkey, path FROM p",
    "t11_join_parts": "SELECT doc_id, md5(nullif(array_to_string(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), chr(10)), '')) AS digest FROM documents",
    "t12_json_keys": "SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY 1",
    "t13_json_coerce": "SELECT event_id, CAST(coalesce(props->>'content', props->>'text', props->>'k') AS BIGINT) AS value FROM events",
    "t14_context_left": "SELECT doc_id, CAST(round(greatest(0.0, least(100.0, greatest(116000 - greatest(n_chars * 4 - 12000, 0), 0) / 116000 * 100))) AS BIGINT) AS percent FROM documents",
    "t15_derived_usage": "SELECT l_returnflag, CAST(sum(greatest(floor(l_quantity) - floor(l_quantity * l_discount * 10), 0)) AS BIGINT) AS non_cached, CAST(sum(greatest(floor(l_quantity * l_discount * 10), 0)) AS BIGINT) AS cached FROM lineitem GROUP BY 1",
    "t17_indent": "SELECT doc_id, CAST(doc_id % 3 * 4 + doc_id % 5 AS INTEGER) AS indent FROM documents",
    "t18_sha1": "SELECT doc_id, sha1(text) AS digest, sha1('blob ' || strlen(text) || chr(0) || text) AS blob_id FROM documents",
    "t19_head_tail": "SELECT doc_id, CASE WHEN length(text) > 40 THEN left(text, 20) || right(text, 20) ELSE text END AS kept FROM documents",
    "j14_match_rules": f"WITH {MATCH_SQL} SELECT id, count(*) AS rules, CAST(max(matched) AS BIGINT) AS longest FROM m GROUP BY 1",
    "a13_decide": f"WITH {MATCH_SQL} SELECT c.id, CAST(coalesce(max(m.severity), 1) AS INTEGER) AS severity FROM c LEFT JOIN m USING (id) GROUP BY 1",
    "a14_allowed_prefixes": f"WITH {MATCH_SQL} SELECT DISTINCT array_to_string(argv[1:matched], ' ') AS prefix FROM m WHERE severity = 0",
    "j15_match_hosts": f"""WITH {PATTERN_SQL}, h AS (SELECT DISTINCT CASE WHEN page_id % 5 = 0 THEN 'www.' || {HOST_SQL} ELSE {HOST_SQL} END AS host FROM pages)
      SELECT host, coalesce(bool_and(allow), false) AS allowed FROM h LEFT JOIN pat ON (how = 2 AND host = base) OR (how = 0 AND ends_with(host, '.' || base)) OR (how = 1 AND (host = base OR ends_with(host, '.' || base))) GROUP BY 1""",
    "j16_contains": f"WITH {PATTERN_SQL}, q AS (SELECT DISTINCT pattern, base FROM pat) SELECT a.pattern AS a, b.pattern AS b FROM q a JOIN q b USING (base) WHERE starts_with(a.pattern, '**.') OR a.pattern = b.pattern",
    "j17_longest_prefix": f"{P}, r AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS root FROM p WHERE regexp_replace(path, '/[^/]*$', '') LIKE '%1%' UNION SELECT 'src') SELECT path, arg_max(root, length(root)) AS root FROM (SELECT DISTINCT path FROM p) JOIN r ON path = root OR starts_with(path, root || '/') GROUP BY 1",
    "n01_session_filter": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND instr(lower(o_orderpriority), 'urg') > 0",
    "n03_commit_rows": "SELECT event_id AS id, CAST(floor(epoch(ts)) AS BIGINT) AS ts, event_type AS subject FROM events WHERE event_id % 11 <> 0",
    "n04_default_first": "SELECT p_brand, row_number() OVER (ORDER BY p_brand <> 'Brand#9', p_brand) AS place FROM (SELECT DISTINCT p_brand FROM part)",
    "n05_collapse_repeats": "SELECT event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS l FROM events) WHERE l IS DISTINCT FROM event_type",
    "n05_commands": """WITH e AS (SELECT event_id, event_id % 12 AS k, event_type AS t, CAST(user_id AS VARCHAR) AS u FROM events)
      SELECT event_id, n, kind, cmd, name, query, path FROM e, LATERAL (VALUES (0, 0, 'read', 'cat ' || u || '.py', u || '.py', NULL, 'src/' || t || '/' || u || '.py'), (1, 0, 'read', 'sed -n 1,20p ' || t || '/' || u || '.rs', u || '.rs', NULL, '/a/b/' || t || '/' || u || '.rs'),
        (2, 0, 'search', 'rg -n -g ''*.py'' ' || t || ' src/' || u || '/', NULL, t, u), (3, 0, 'list', 'ls -la packages/' || u || '/src', NULL, NULL, u), (4, 0, 'read', 'cat ' || t, t, NULL, t), (5, 0, 'search', 'grep -e ' || t || ' -m 3 logs/' || u, NULL, t, u),
        (6, 0, 'unknown', 'wc -l; sort', NULL, NULL, NULL), (7, 0, 'search', 'find . -name ' || t, NULL, t, '.'), (8, 0, 'unknown', 'cat ' || u || ' > out', NULL, NULL, NULL), (9, 0, 'list', 'python3 -c ''import os; os.walk(1)''', NULL, NULL, NULL),
        (10, 0, 'read', 'head -n 5 ' || t, t, NULL, t), (10, 1, 'read', 'tail -n +3 ' || u, u, NULL, u), (10, 2, 'list', 'git ls-files build/', NULL, NULL, 'build'), (11, 0, 'unknown', 'make', NULL, NULL, NULL)) v(j, n, kind, cmd, name, query, path) WHERE k = j""",
    "n06_word_commands": """SELECT event_id, n, array_to_string(words, chr(10)) AS words FROM (SELECT event_id, ['cat', event_type || '/' || user_id] AS a, CASE event_id % 7 WHEN 0 THEN ['ls', '-l'] WHEN 1 THEN ['head', '-n', '3'] WHEN 2 THEN ['echo', 'a && b'] ELSE ['echo', 'x y'] END AS b FROM events WHERE event_id % 7 IN (0, 1, 2, 5)),
      LATERAL (VALUES (0, a), (1, b)) v(n, words)""",
    "n08_path_by_id": f"""{P}, t AS (SELECT * FROM p WHERE p_partkey % 9 <> 0), s AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'old/' || path ELSE path END AS stored FROM p WHERE p_partkey % 4 <> 0), g AS (SELECT * FROM s WHERE stored IN (SELECT path FROM t))
      SELECT p.p_partkey, coalesce(g.stored, t.path) AS path, g.stored IS NULL AND t.path IS NOT NULL AS repaired FROM p LEFT JOIN g USING (p_partkey) LEFT JOIN t USING (p_partkey)""",
    "n07_items": """WITH e AS (SELECT event_id, ts, user_id, CASE event_type WHEN 'view' THEN 'begin' WHEN 'purchase' THEN 'end' ELSE 'message' END AS what, CASE WHEN event_id % 7 <> 0 THEN event_id % 3 END AS call FROM events),
      p AS (SELECT *, lag(what) OVER w AS kind, lag(event_id) OVER w AS b FROM e WHERE what <> 'message' AND call IS NOT NULL WINDOW w AS (PARTITION BY user_id, call ORDER BY ts, event_id)),
      x AS (SELECT e.*, b AS begun FROM e LEFT JOIN p ON p.event_id = e.event_id AND p.what = 'end' AND kind = 'begin'),
      n AS (SELECT *, sum(CASE WHEN begun IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - 1 AS no FROM x)
      SELECT n.event_id, CASE n.what WHEN 'begin' THEN 'item.started' ELSE 'item.completed' END AS event, 'item_' || CAST(coalesce(m.no, n.no) AS BIGINT) AS item, n.begun FROM n LEFT JOIN n m ON m.event_id = n.begun""",
    "n07_pair_events": "SELECT event_id, \"end\" FROM (SELECT event_id, event_type, first_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS \"end\" FROM events) WHERE event_type = 'view'",
}
