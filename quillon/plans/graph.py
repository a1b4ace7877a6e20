"""Lineage queries over graphs made from the tables.

The asset graph: customers form a tree (customer k hangs below customer k div 3) and every order
hangs below its customer. The place graph: suppliers lead to nations, nations to regions, and the
regions form a ring, which is a cycle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from quillon.operators import lineage
from quillon.plans.registry import query, rounded, table


def _node(kind: str, column):
    return F.concat(F.lit(f"{kind}:"), column.cast("string"))


def asset_edges(spark, folder):
    key = F.col("c_custkey")
    tree = table(spark, folder, "customer").filter(key > 0).select(
        _node("customer", F.floor(key / 3)).alias("source"),
        _node("customer", key).alias("target"),
        F.concat(F.lit("derive-"), F.col("c_mktsegment")).alias("transformation"),
    )
    placed = table(spark, folder, "orders").select(
        _node("customer", F.col("o_custkey")).alias("source"),
        _node("order", F.col("o_orderkey")).alias("target"),
        F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("place-"), F.col("o_orderstatus"))).alias("transformation"),
    )
    return tree.unionAll(placed)


def asset_nodes(spark, folder):
    kind = F.when(F.col("c_mktsegment") == "FURNITURE", "model").when(F.col("c_mktsegment").isin("MACHINERY", "BUILDING"), "feature").otherwise("data_source")
    customers = table(spark, folder, "customer").select(_node("customer", F.col("c_custkey")).alias("node"), kind.alias("type"))
    orders = table(spark, folder, "orders").select(_node("order", F.col("o_orderkey")).alias("node"), F.lit("table").alias("type"))
    return customers.unionAll(orders)


def place_edges(spark, folder):
    suppliers = table(spark, folder, "supplier").select(_node("supplier", F.col("s_suppkey")).alias("source"), _node("nation", F.col("s_nationkey")).alias("target"))
    nations = table(spark, folder, "nation").select(_node("nation", F.col("n_nationkey")).alias("source"), _node("region", F.col("n_regionkey")).alias("target"))
    ring = table(spark, folder, "region").select(_node("region", F.col("r_regionkey")).alias("source"), _node("region", (F.col("r_regionkey") + 1) % 5).alias("target"))
    orders = table(spark, folder, "orders").select(_node("order", F.col("o_orderkey")).alias("source"), _node("customer", F.col("o_custkey")).alias("target"))
    return reduce(DataFrame.unionAll, [suppliers, nations, ring, orders])


def roots(spark, *names):
    return spark.createDataFrame([(name,) for name in names], "node string")


EDGES = """
WITH RECURSIVE edges AS (
  SELECT 'customer:' || (c_custkey // 3) AS source, 'customer:' || c_custkey AS target, 'derive-' || c_mktsegment AS transformation FROM customer WHERE c_custkey > 0
  UNION ALL SELECT 'customer:' || o_custkey, 'order:' || o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN 'place-' || o_orderstatus END FROM orders),
nodes AS (SELECT 'customer:' || c_custkey AS node, CASE WHEN c_mktsegment = 'FURNITURE' THEN 'model' WHEN c_mktsegment IN ('MACHINERY', 'BUILDING') THEN 'feature' ELSE 'data_source' END AS type FROM customer
  UNION ALL SELECT 'order:' || o_orderkey, 'table' FROM orders),
"""


def _down(names, depth):
    start = ", ".join(f"('{n}')" for n in names)
    return f"""
down AS (SELECT x AS root, x AS node, 0 AS depth FROM (VALUES {start}) v(x)
  UNION SELECT root, target, depth + 1 FROM down JOIN edges ON node = source WHERE depth < {depth}),
reached AS (SELECT root, node, depth FROM down WHERE depth > 0)
"""


@query("lineage_downstream", EDGES + _down(["customer:1", "customer:4"], 10) + "SELECT root, node, depth FROM reached")
def lineage_downstream(spark, folder):
    return lineage.reach(asset_edges(spark, folder), roots(spark, "customer:1", "customer:4"), "downstream", 10)


@query("lineage_upstream", EDGES + """
up AS (SELECT node AS root, node, 0 AS depth FROM nodes WHERE type = 'table' UNION SELECT root, source, depth + 1 FROM up JOIN edges ON node = target WHERE depth < 3)
SELECT root, node, depth FROM up WHERE depth > 0""")
def lineage_upstream(spark, folder):
    orders = asset_nodes(spark, folder).filter(F.col("type") == "table").select("node")
    return lineage.reach(asset_edges(spark, folder), orders, "upstream", 3)


@query("lineage_cycle_closure", """
SELECT 'region:0' AS root, 'region:' || r_regionkey AS node, CASE WHEN r_regionkey = 0 THEN 5 ELSE r_regionkey END::INTEGER AS depth FROM region""")
def lineage_cycle_closure(spark, folder):
    return lineage.reach(place_edges(spark, folder), roots(spark, "region:0"), "downstream", 10)


@query("lineage_path", """
WITH RECURSIVE up AS (SELECT c_custkey AS k, ['customer:' || c_custkey] AS path FROM customer WHERE c_custkey = 119
  UNION ALL SELECT k // 3, list_prepend('customer:' || (k // 3), path) FROM up WHERE k > 0)
SELECT array_to_string(path, '>') AS path FROM up WHERE k = 0""")
def lineage_path(spark, folder):
    found = lineage.shortest_path(asset_edges(spark, folder), "customer:0", "customer:119")
    return found.select(F.array_join("path", ">").alias("path"))


ROOTS = ["customer:1", "customer:5", "customer:40"]


@query("lineage_impact_by_type", EDGES + _down(ROOTS, 10) + """
SELECT root, type, count(*) AS asset_count FROM reached JOIN nodes USING (node) GROUP BY ALL""")
def lineage_impact_by_type(spark, folder):
    reached = lineage.reach(asset_edges(spark, folder), roots(spark, *ROOTS), max_depth=10)
    return lineage.impact_by_type(reached, asset_nodes(spark, folder))


@query("lineage_impact", EDGES + _down(ROOTS, 10) + """
, t AS (SELECT DISTINCT root, transformation FROM reached JOIN edges ON node = target WHERE transformation IS NOT NULL),
s AS (SELECT x AS root, (SELECT count(*) FROM reached r WHERE r.root = x) AS downstream_count, (SELECT count(*) FROM t WHERE t.root = x) AS transformation_count
  FROM (VALUES ('customer:1'), ('customer:5'), ('customer:40')) v(x))
SELECT *, downstream_count + 2 * transformation_count AS risk_score, CASE WHEN downstream_count + 2 * transformation_count >= 20 THEN 'HIGH'
  WHEN downstream_count + 2 * transformation_count >= 10 THEN 'MEDIUM' WHEN downstream_count + 2 * transformation_count >= 5 THEN 'LOW' ELSE 'MINIMAL' END AS risk_level FROM s""")
def lineage_impact(spark, folder):
    edges, start = asset_edges(spark, folder), roots(spark, *ROOTS)
    return lineage.impact_summary(edges, start, lineage.reach(edges, start, max_depth=10))


@query("lineage_dangling", """
SELECT 'missing source' AS problem, 'customer:' || c_custkey AS reference FROM customer WHERE c_custkey % 100 = 7 AND
  (c_custkey IN (SELECT o_custkey FROM orders) OR c_custkey * 3 <= (SELECT max(c_custkey) FROM customer))
UNION ALL SELECT 'missing target', 'customer:' || c_custkey FROM customer WHERE c_custkey % 100 = 7
UNION ALL SELECT 'missing transformation', 'place-' || s FROM (SELECT DISTINCT o_orderstatus AS s FROM orders WHERE o_orderkey % 3 <> 0)""")
def lineage_dangling(spark, folder):
    known = asset_nodes(spark, folder).filter(~F.col("node").rlike("^customer:(|[0-9]*[^0-9]?)[0-9]*07$") & (F.col("node") != "customer:7"))
    steps = table(spark, folder, "customer").select(F.concat(F.lit("derive-"), F.col("c_mktsegment")).alias("id")).distinct()
    return lineage.dangling_edges(asset_edges(spark, folder), known, steps)


@query("lineage_circular", """
SELECT 'supplier:' || s_suppkey AS node FROM supplier UNION ALL SELECT 'nation:' || n_nationkey FROM nation UNION ALL SELECT 'region:' || r_regionkey FROM region""")
def lineage_circular(spark, folder):
    return lineage.circular_assets(place_edges(spark, folder))


NEAR = """
near AS (SELECT 'customer:13' AS root, 'customer:13' AS node, 0 AS depth
  UNION SELECT root, CASE WHEN node = source THEN target ELSE source END, depth + 1 FROM near JOIN edges ON node IN (source, target) WHERE depth < 2),
least_depth AS (SELECT root, node, min(depth) AS depth FROM near GROUP BY ALL)
"""


@query("lineage_neighbourhood_nodes", EDGES + NEAR + "SELECT root, node, depth FROM least_depth")
def lineage_neighbourhood_nodes(spark, folder):
    return lineage.neighbourhood(asset_edges(spark, folder), roots(spark, "customer:13"), 2, "both")[0]


@query("lineage_neighbourhood_edges", EDGES + NEAR + """
SELECT DISTINCT root, source, target, transformation FROM least_depth JOIN edges ON node IN (source, target) WHERE depth < 2""")
def lineage_neighbourhood_edges(spark, folder):
    return lineage.neighbourhood(asset_edges(spark, folder), roots(spark, "customer:13"), 2, "both")[1]


@query("lineage_feature_impact", EDGES + _down(["customer:2", "customer:30", "customer:400"], 5) + """
SELECT root, count(*) FILTER (type = 'feature') AS feature_count, count(*) FILTER (type = 'model') AS model_count,
  round(least(count(*) FILTER (type = 'feature') * 0.1 + count(*) FILTER (type = 'model') * 0.3, 1.0)::DOUBLE, 6) AS impact_score FROM down JOIN nodes USING (node) GROUP BY ALL""")
def lineage_feature_impact(spark, folder):
    start = roots(spark, "customer:2", "customer:30", "customer:400")
    made = lineage.feature_impact(asset_edges(spark, folder), asset_nodes(spark, folder), start, 5)
    return rounded(made, 6, "impact_score")


@query("lineage_most_connected", EDGES.rstrip().rstrip(",") + """
SELECT node, count(*) AS degree FROM (SELECT source AS node FROM edges UNION ALL SELECT target FROM edges) GROUP BY ALL ORDER BY degree DESC, node LIMIT 5""")
def lineage_most_connected(spark, folder):
    return lineage.most_connected(asset_edges(spark, folder))


@query("lineage_dependencies", EDGES.rstrip().rstrip(",") + """
SELECT DISTINCT target AS node, source AS neighbour, type FROM edges JOIN nodes ON source = node WHERE type IN ('data_source', 'feature') AND source <> target""")
def lineage_dependencies(spark, folder):
    return lineage.direct_neighbours(asset_edges(spark, folder), asset_nodes(spark, folder), "upstream", ["data_source", "feature"])


@query("lineage_consumers", EDGES.rstrip().rstrip(",") + """
SELECT DISTINCT source AS node, target AS neighbour, type FROM edges JOIN nodes ON target = node WHERE type IN ('model', 'feature') AND source <> target""")
def lineage_consumers(spark, folder):
    return lineage.direct_neighbours(asset_edges(spark, folder), asset_nodes(spark, folder), "downstream", ["model", "feature"])


@query("lineage_orphans", "SELECT 'document:' || doc_id AS node FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def lineage_orphans(spark, folder):
    """Documents to which no label leads."""
    labelled = table(spark, folder, "labels").select(_node("label", F.col("doc_id")).alias("source"), _node("document", F.col("doc_id")).alias("target"))
    return lineage.orphans(labelled, table(spark, folder, "documents").select(_node("document", F.col("doc_id")).alias("node")))
