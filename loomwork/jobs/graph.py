"""Graph queries (G01-G16, J01-J07) over keys of the star schema."""

from pyspark.sql import functions as F

from loomwork.operators import graph, path_index
from loomwork.sources.tables import GRAPH_SQL, edges, nodes, table


#: Modules made of parts: names, names behind a package, pieces of addresses in two notations, and some that nothing contains.
MODULES = """case when p_partkey % 5 = 0 then p_name when p_partkey % 5 = 1 then concat('lib.', p_name) when p_partkey % 5 = 2 then concat('example.com.fr.', cast(p_size as varchar(20)))
  when p_partkey % 5 = 3 then concat('en::', cast(p_partkey % 100 as varchar(20))) else concat('none.such', cast(p_size as varchar(20))) end"""


def _near(spark, sf, kind, where, incoming):
    out = graph.neighbours(nodes(spark, sf).where(where), edges(spark, sf), kind, incoming)
    return out.select("name", "id", "other")


def g01_callers(spark, sf):
    return _near(spark, sf, "Calls", "kind = 'Customer'", True)


def g02_callees(spark, sf):
    return _near(spark, sf, "Calls", "kind = 'Order'", False)


def g03_dependencies(spark, sf):
    return _near(spark, sf, "Imports", "kind = 'Order'", False)


def g04_dependents(spark, sf):
    return _near(spark, sf, "Imports", "kind = 'Part'", True)


def g05_subclasses(spark, sf):
    return _near(spark, sf, "Inherits", "kind = 'Supplier'", True)


def g06_superclasses(spark, sf):
    return _near(spark, sf, "Inherits", "kind = 'Part'", False)


def g07_shortest_path(spark, sf):
    """From every node of one name to another node, however far."""
    n = nodes(spark, sf)
    return graph.shortest_paths(edges(spark, sf), n.where("name = '1-URGENT'"), n.where("kind = 'Supplier' and ord = 1"))


def g08_related(spark, sf):
    return graph.within_hops(edges(spark, sf), nodes(spark, sf).where("kind = 'Supplier'"), 2)


def g09_source(spark, sf):
    return nodes(spark, sf).where("id = 'o42'")


def g10_stats(spark, sf):
    n = nodes(spark, sf).agg(F.count("*").alias("nodes"), F.countDistinct("kind").alias("kinds"), F.countDistinct("name").alias("files"))
    return n.join(edges(spark, sf).agg(F.count("*").alias("edges")))  # one row each


def g11_files(spark, sf):
    return nodes(spark, sf).select(F.col("name").alias("path")).distinct().orderBy("path")


def g12_elements(spark, sf):
    return nodes(spark, sf).orderBy("id")


def g13_file_elements(spark, sf):
    return nodes(spark, sf).where("kind = 'Order'").groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def g14_resolve(spark, sf):
    """Rows of every exported symbol."""
    n = nodes(spark, sf)
    return n.join(n.where("kind = 'Part'").select("name").distinct(), "name", "left_semi").select("name", "id")


def g15_remove(spark, sf):
    n, e = graph.remove(nodes(spark, sf), edges(spark, sf), nodes(spark, sf).where("kind = 'Part' and name like 'red%'"))
    return e.groupBy("kind").agg(F.count("*").alias("edges")).join(n.agg(F.count("*").alias("nodes")))


def g16_replace(spark, sf):
    """Orders of low priority come back without their calls and under a new name."""
    n, e = nodes(spark, sf), edges(spark, sf)
    changed = n.where("kind = 'Order' and name = '5-LOW'")
    mine = changed.select(F.col("id").alias("src_id"))
    new = e.where("kind = 'Imports'").join(mine, "src_id", "left_semi").select("src_id", "dst_id", "kind")
    got_n, got_e = graph.replace(n, e, changed.withColumn("name", F.lit("changed")), new, changed)
    return got_e.groupBy("kind").agg(F.count("*").alias("edges")).join(got_n.agg(F.count_if(F.col("name") == "changed").alias("changed")))


def j01_defines(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority"), "l_orderkey")


def j02_calls(spark, sf):
    """Per customer the supplier of its nation with a balance less than 500 above its own, else of the same remainder, else any; the first by key of these, left out if it is the customer's number."""
    calls = table(spark, sf, "customer").select(F.col("c_custkey").alias("ask"), F.col("c_nationkey").alias("name"), F.col("c_acctbal").alias("at")).where("ask is not null")
    # keys that aren't there come last
    found = table(spark, sf, "supplier").select(F.struct(F.col("s_suppkey").isNull().alias("none"), "s_suppkey").alias("key"), F.col("s_nationkey").alias("name"), F.col("s_acctbal").alias("at"), (F.col("s_suppkey") % 5).alias("rest"))
    near = graph.least_in_band(calls, found.drop("rest"), 500).select("ask", F.lit(1).alias("priority"), "least")
    alike = calls.withColumn("rest", F.col("ask") % 5).join(found.groupBy("name", "rest").agg(F.min("key").alias("least")), ["name", "rest"]).select("ask", F.lit(2), "least")
    some = calls.join(found.groupBy("name").agg(F.min("key").alias("least")), "name").select("ask", F.lit(3), "least")
    best = near.union(alike).union(some).groupBy(F.col("ask").alias("c_custkey")).agg(F.min(F.struct("priority", "least")).alias("best"))
    return best.select("c_custkey", F.col("best.least.s_suppkey").alias("s_suppkey"), F.col("best.priority").alias("priority")).where("s_suppkey <> c_custkey")


def j03_context(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_type")
    return graph.starting_with(p, "p_name", p.where("p_type = 'PROMO'").select(F.substring("p_name", 1, 6).alias("imported")), "imported")


def j04_imports(spark, sf):
    """Exact, then the package, then the parent."""
    o, c = table(spark, sf, "orders").select("o_orderkey"), table(spark, sf, "customer")
    exact = c.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_orderkey"), F.col("c_custkey").alias("a"))
    package = c.where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("p"), F.col("c_custkey").alias("b"))
    parent = c.select(F.col("c_custkey").alias("q"), F.col("c_custkey").alias("d"))
    x = o.join(exact, "o_orderkey", "left").withColumn("p", F.col("o_orderkey") - 1).join(package, "p", "left")
    x = x.withColumn("q", F.floor(F.col("o_orderkey") / 10)).join(parent, "q", "left")
    return x.select("o_orderkey", F.coalesce("a", "b", "d").alias("target"))


def j05_import_symbols(spark, sf):
    """Each word of a part's name to the first part whose type is that word in capitals, else to the first part named so."""
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_type")
    names = p.select("p_partkey", F.explode(F.split("p_name", " ")).alias("word"))
    typed = p.groupBy(F.lower("p_type").alias("word")).agg(F.min("p_partkey").alias("by_type"))
    named = p.select(F.substring_index("p_name", " ", -1).alias("word"), "p_partkey").groupBy("word").agg(F.min("p_partkey").alias("by_name"))
    return names.join(typed, "word", "left").join(named, "word", "left").select("p_partkey", "word", F.coalesce("by_type", "by_name").alias("target")).where("target is not null")


def j06_import_heuristic(spark, sf):
    """Modules without a file of their own: the first part whose name is the module, else its last segment after '.', else the first address that contains the module with '/' for '.' and '::'. Others are left out."""
    p, pages = table(spark, sf, "part"), table(spark, sf, "pages").select(F.col("url").alias("path"))
    m = p.selectExpr(f"{MODULES} as module").distinct().withColumn("last", F.substring_index("module", ".", -1)).withColumn("normal", F.replace(F.replace("module", F.lit("."), F.lit("/")), F.lit("::"), F.lit("/")))
    named = p.groupBy(F.col("p_name").alias("module")).agg(F.concat(F.lit("part "), F.min("p_partkey")).alias("exact"))
    m = m.join(named, "module", "left").join(named.toDF("last", "tail"), "last", "left")
    inside = path_index.first_containing(pages, m.where("exact is null and tail is null").select(F.col("normal").alias("needle"))).toDF("normal", "inside")
    return m.join(inside, "normal", "left").select("module", F.coalesce("exact", "tail", "inside").alias("target")).where("target is not null")


def j07_inherits(spark, sf):
    """A base name to the first node of that name, whatever its kind."""
    return graph.first_by(nodes(spark, sf), ["name"], "ord", "kind").select("name", "id")


QUERIES = {n: f for n, f in list(globals().items()) if n[:1] in "gj" and n[1:3].isdigit()}
G = f"WITH {GRAPH_SQL}"


def _near_sql(kind, where, incoming):
    here, there = ("dst_id", "src_id") if incoming else ("src_id", "dst_id")
    return f"{G} SELECT n.name, n.id, e.{there} AS other FROM nodes n JOIN edges e ON e.{here} = n.id AND e.kind = '{kind}' WHERE n.{where}"


ORACLES = {
    "g01_callers": _near_sql("Calls", "kind = 'Customer'", True),
    "g02_callees": _near_sql("Calls", "kind = 'Order'", False),
    "g03_dependencies": _near_sql("Imports", "kind = 'Order'", False),
    "g04_dependents": _near_sql("Imports", "kind = 'Part'", True),
    "g05_subclasses": _near_sql("Inherits", "kind = 'Supplier'", True),
    "g06_superclasses": _near_sql("Inherits", "kind = 'Part'", False),
    "g07_shortest_path": f"""WITH RECURSIVE {GRAPH_SQL}, e AS (SELECT DISTINCT src_id, dst_id FROM edges), walk(source, cur, path, hops) AS (
      SELECT id, id, id, 0 FROM nodes WHERE name = '1-URGENT' UNION ALL
      SELECT source, dst_id, path || '>' || dst_id, hops + 1 FROM walk JOIN e ON src_id = cur WHERE hops < 3),
      best AS (SELECT source, cur, min(hops) AS hops FROM walk GROUP BY 1, 2)
      SELECT w.source, w.cur AS target, w.hops, min(w.path) AS path FROM walk w JOIN best b ON b.source = w.source AND b.cur = w.cur AND b.hops = w.hops
      WHERE w.cur IN (SELECT id FROM nodes WHERE kind = 'Supplier' AND ord = 1) GROUP BY 1, 2, 3""",
    "g08_related": f"""{G}, b AS (SELECT src_id AS a, dst_id AS b FROM edges UNION SELECT dst_id, src_id FROM edges), s AS (SELECT id FROM nodes WHERE kind = 'Supplier'),
      h1 AS (SELECT DISTINCT b AS id FROM b WHERE a IN (SELECT id FROM s) AND b NOT IN (SELECT id FROM s)), h2 AS (SELECT DISTINCT b AS id FROM b WHERE a IN (SELECT id FROM h1) AND b NOT IN (SELECT id FROM s) AND b NOT IN (SELECT id FROM h1))
      SELECT id, 1 AS hops FROM h1 UNION ALL SELECT id, 2 FROM h2""",
    "g09_source": f"{G} SELECT * FROM nodes WHERE id = 'o42'",
    "g10_stats": f"{G} SELECT count(*) AS nodes, count(DISTINCT kind) AS kinds, count(DISTINCT name) AS files, (SELECT count(*) FROM edges) AS edges FROM nodes",
    "g11_files": f"{G} SELECT DISTINCT name AS path FROM nodes",
    "g12_elements": f"{G} SELECT * FROM nodes",
    "g13_file_elements": f"{G} SELECT name, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM nodes WHERE kind = 'Order' GROUP BY 1",
    "g14_resolve": f"{G} SELECT name, id FROM nodes WHERE name IN (SELECT name FROM nodes WHERE kind = 'Part')",
    "g15_remove": f"{G}, gone AS (SELECT id FROM nodes WHERE kind = 'Part' AND name LIKE 'red%') SELECT kind, count(*) AS edges, (SELECT count(*) FROM nodes WHERE id NOT IN (SELECT id FROM gone)) AS nodes FROM edges WHERE src_id NOT IN (SELECT id FROM gone) AND dst_id NOT IN (SELECT id FROM gone) GROUP BY 1",
    "g16_replace": f"{G}, c AS (SELECT id FROM nodes WHERE kind = 'Order' AND name = '5-LOW') SELECT kind, count(*) AS edges, (SELECT count(*) FROM c) AS changed FROM edges WHERE NOT (kind = 'Calls' AND src_id IN (SELECT id FROM c)) GROUP BY 1",
    "j01_defines": "SELECT l_orderkey, l_linenumber, l_partkey, o_orderpriority FROM lineitem JOIN orders ON o_orderkey = l_orderkey",
    "j02_calls": """SELECT c_custkey, s_suppkey, priority FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY priority, s_suppkey) AS rn FROM (
      SELECT c_custkey, s_suppkey, CASE WHEN s_acctbal > c_acctbal AND s_acctbal < c_acctbal + 500 THEN 1 WHEN s_suppkey % 5 = c_custkey % 5 THEN 2 ELSE 3 END AS priority
      FROM customer JOIN supplier ON s_nationkey = c_nationkey)) WHERE rn = 1 AND s_suppkey <> c_custkey""",
    "j03_context": "SELECT p_partkey, p_name, p_type FROM part p WHERE EXISTS (SELECT 1 FROM part i WHERE i.p_type = 'PROMO' AND starts_with(p.p_name, left(i.p_name, 6)))",
    "j04_imports": """SELECT o_orderkey, coalesce(a.c_custkey, b.c_custkey, d.c_custkey) AS target FROM orders LEFT JOIN customer a ON a.c_custkey = o_orderkey AND a.c_mktsegment = 'BUILDING'
      LEFT JOIN customer b ON b.c_custkey = o_orderkey - 1 AND b.c_mktsegment = 'MACHINERY' LEFT JOIN customer d ON d.c_custkey = o_orderkey // 10""",
    "j05_import_symbols": """WITH w AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part), t AS (SELECT lower(p_type) AS word, min(p_partkey) AS by_type FROM part GROUP BY 1),
      n AS (SELECT string_split(p_name, ' ')[-1] AS word, min(p_partkey) AS by_name FROM part GROUP BY 1)
      SELECT p_partkey, word, coalesce(by_type, by_name) AS target FROM w LEFT JOIN t USING (word) LEFT JOIN n USING (word) WHERE coalesce(by_type, by_name) IS NOT NULL""",
    "j06_import_heuristic": f"""WITH m AS (SELECT DISTINCT {MODULES} AS module FROM part), n AS (SELECT p_name, 'part ' || min(p_partkey) AS id FROM part GROUP BY 1)
      SELECT module, target FROM (SELECT module, coalesce((SELECT id FROM n WHERE p_name = module), (SELECT id FROM n WHERE p_name = split_part(module, '.', -1)),
        (SELECT min(url) FROM pages WHERE contains(url, replace(replace(module, '.', '/'), '::', '/')))) AS target FROM m) WHERE target IS NOT NULL""",
    "j07_inherits": f"{G} SELECT name, id FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ord, kind) AS rn FROM nodes) WHERE rn = 1",
}
