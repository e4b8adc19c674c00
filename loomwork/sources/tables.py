"""Readers of the given tables, and views of them in the shapes of the operators."""


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df, rows):
    """``df`` dealt over a task for every ``rows`` rows: what is made of them may cost far more than the files' size says."""
    return df.repartition(max(1, -(-df.count() // rows)))


def logs(spark, sf_dir):
    """``events`` as log rows: some without thread, some of these without process."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id as id", "ts", "case when user_id % 5 = 0 then null else user_id end as thread_id", "case when user_id % 10 = 0 then null else user_id % 4 end as process_id",
        "event_type as level", "props as message", "value", "cast(octet_length(props) + octet_length(event_type) as bigint) as estimated_bytes",
    )


LOGS_SQL = """logs AS (SELECT event_id AS id, ts, CASE WHEN user_id % 5 = 0 THEN NULL ELSE user_id END AS thread_id,
  CASE WHEN user_id % 10 = 0 THEN NULL ELSE user_id % 4 END AS process_id, event_type AS level, props AS message, value,
  CAST(strlen(props) + strlen(event_type) AS BIGINT) AS estimated_bytes FROM events)"""


def nodes(spark, sf_dir):
    """Keys of customers, orders, parts and suppliers as graph nodes: id, kind, name, ord (order of insertion)."""
    o = table(spark, sf_dir, "orders").selectExpr("concat('o', o_orderkey) as id", "'Order' as kind", "o_orderpriority as name", "o_orderkey as ord")
    c = table(spark, sf_dir, "customer").selectExpr("concat('c', c_custkey) as id", "'Customer' as kind", "c_name as name", "c_custkey as ord")
    p = table(spark, sf_dir, "part").selectExpr("concat('p', p_partkey) as id", "'Part' as kind", "p_name as name", "p_partkey as ord")
    s = table(spark, sf_dir, "supplier").selectExpr("concat('s', s_suppkey) as id", "'Supplier' as kind", "s_name as name", "s_suppkey as ord")
    return o.union(c).union(p).union(s)


def edges(spark, sf_dir):
    """Orders call their customers, import their parts; parts inherit from their suppliers. A bag: one edge per row."""
    line = table(spark, sf_dir, "lineitem")
    calls = table(spark, sf_dir, "orders").selectExpr("concat('o', o_orderkey) as src_id", "concat('c', o_custkey) as dst_id", "'Calls' as kind")
    imports = line.selectExpr("concat('o', l_orderkey) as src_id", "concat('p', l_partkey) as dst_id", "'Imports' as kind")
    inherits = line.selectExpr("concat('p', l_partkey) as src_id", "concat('s', l_suppkey) as dst_id", "'Inherits' as kind").distinct()
    return calls.union(imports).union(inherits)


GRAPH_SQL = """nodes AS (SELECT 'o' || o_orderkey AS id, 'Order' AS kind, o_orderpriority AS name, o_orderkey AS ord FROM orders
  UNION ALL SELECT 'c' || c_custkey, 'Customer', c_name, c_custkey FROM customer
  UNION ALL SELECT 'p' || p_partkey, 'Part', p_name, p_partkey FROM part
  UNION ALL SELECT 's' || s_suppkey, 'Supplier', s_name, s_suppkey FROM supplier),
edges AS (SELECT 'o' || o_orderkey AS src_id, 'c' || o_custkey AS dst_id, 'Calls' AS kind FROM orders
  UNION ALL SELECT 'o' || l_orderkey, 'p' || l_partkey, 'Imports' FROM lineitem
  UNION ALL SELECT DISTINCT 'p' || l_partkey, 's' || l_suppkey, 'Inherits' FROM lineitem)"""
