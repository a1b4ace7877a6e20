"""Cube queries over sales: lineitem with its order, customer, nation and region."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillon.operators import olap
from quillon.operators.olap import Cube, CubeQuery, CubeSchema, Dimension, Level, Measure
from quillon.plans.registry import query, rounded, table

SALES = """
WITH sales AS (
  SELECT r_name, n_name, c_mktsegment, o_orderpriority, o_orderstatus, l_returnflag, l_linestatus,
         l_quantity, l_discount, l_extendedprice, l_suppkey, l_extendedprice * (1 - l_discount) AS amount,
         CAST(year(o_orderdate) AS INTEGER) AS order_year, CAST(month(o_orderdate) AS INTEGER) AS order_month
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
"""

SALES_CUBE = CubeSchema(
    "sales",
    (
        Dimension("region", "r_name"),
        Dimension("nation", "n_name"),
        Dimension("segment", "c_mktsegment"),
        Dimension("priority", "o_orderpriority"),
        Dimension("status", "o_orderstatus"),
        Dimension("returnflag", "l_returnflag"),
        Dimension("linestatus", "l_linestatus"),
        Dimension("year", "order_year", "temporal"),
        Dimension(
            "geography", "r_name", "hierarchical", (Level("geo_region", "r_name", 1), Level("geo_nation", "n_name", 2))
        ),
        Dimension(
            "calendar", "order_year", "hierarchical",
            (Level("cal_year", "order_year", 1), Level("cal_month", "order_month", 2)),
        ),
    ),
    (
        Measure("revenue", "amount", "sum"),
        Measure("quantity", "l_quantity", "sum"),
        Measure("lines", "*", "count"),
        Measure("avg_price", "l_extendedprice", "avg"),
        Measure("min_price", "l_extendedprice", "min"),
        Measure("max_price", "l_extendedprice", "max"),
        Measure("discounted", "l_discount", "count"),
        Measure("suppliers", "l_suppkey", "count_distinct"),
        Measure("quantity_std", "l_quantity", "stddev"),
        Measure("quantity_var", "l_quantity", "variance"),
    ),
)


def customers_placed(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with customer, nation and region. The small sides join first, so a filter on any of
    them thins the orders before they meet the line items."""
    places = (
        table(spark, folder, "customer")
        .join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("c_custkey", "c_mktsegment", "n_name", "r_name")
    )
    return table(spark, folder, "orders").join(places, F.col("o_custkey") == F.col("c_custkey"))


def sales_cube(spark: SparkSession, folder: str) -> Cube:
    """Line-level sales. Unused columns and joins' columns are pruned by Catalyst per query."""
    sales = (
        table(spark, folder, "lineitem")
        .join(customers_placed(spark, folder), F.col("l_orderkey") == F.col("o_orderkey"))
        .withColumn("amount", F.col("l_extendedprice") * (1 - F.col("l_discount")))
        .withColumn("order_year", F.year("o_orderdate"))
        .withColumn("order_month", F.month("o_orderdate"))
    )
    return Cube(sales, SALES_CUBE)


def revenue_cube(spark: SparkSession, folder: str) -> Cube:
    """Order-level revenue: line items are summed per order first, and the join with the orders
    reuses that partitioning."""
    per_order = (
        table(spark, folder, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("amount"))
    )
    facts = per_order.join(customers_placed(spark, folder), F.col("l_orderkey") == F.col("o_orderkey"))
    return Cube(facts, SALES_CUBE)


@query("top_nations_in_region", SALES + """
SELECT n_name AS nation, c_mktsegment AS segment, round(sum(amount), 4) AS revenue FROM sales
WHERE r_name = 'ASIA' GROUP BY ALL ORDER BY sum(amount) DESC, 1, 2 LIMIT 10""")
def top_nations_in_region(spark, folder):
    steps = olap.in_sequence(olap.slice_by("region", "ASIA"), olap.top_n("revenue", 10))
    start = CubeQuery(("region", "nation", "segment"), ("revenue",))
    return rounded(revenue_cube(spark, folder).query(steps(start)), 4, "revenue")


@query("cube_measures", SALES + """
SELECT r_name AS region, l_returnflag AS returnflag, round(sum(amount), 4) AS revenue, sum(l_quantity) AS quantity,
  count(*) AS lines, round(avg(l_extendedprice), 4) AS avg_price, min(l_extendedprice) AS min_price,
  max(l_extendedprice) AS max_price, count(l_discount) AS discounted
FROM sales GROUP BY ALL""")
def cube_measures(spark, folder):
    measures = ("revenue", "quantity", "lines", "avg_price", "min_price", "max_price", "discounted")
    return rounded(sales_cube(spark, folder).query(CubeQuery(("region", "returnflag"), measures)), 4, "revenue", "avg_price")


@query("cube_global", SALES + "SELECT round(sum(amount), 4) AS revenue, count(*) AS lines FROM sales")
def cube_global(spark, folder):
    return rounded(sales_cube(spark, folder).query(CubeQuery((), ("revenue", "lines"))), 4, "revenue")


@query("cube_distinct_suppliers", SALES + """
SELECT n_name AS nation, count(DISTINCT l_suppkey) AS suppliers FROM sales GROUP BY ALL""")
def cube_distinct_suppliers(spark, folder):
    return sales_cube(spark, folder).query(CubeQuery(("nation",), ("suppliers",)))


@query("cube_spread", SALES + """
SELECT o_orderpriority AS priority, round(stddev_samp(l_quantity), 6) AS quantity_std,
  round(var_samp(l_quantity), 6) AS quantity_var FROM sales GROUP BY ALL""")
def cube_spread(spark, folder):
    result = sales_cube(spark, folder).query(CubeQuery(("priority",), ("quantity_std", "quantity_var")))
    return rounded(result, 6, "quantity_std", "quantity_var")


@query("cube_filter_having_order", SALES + """
SELECT n_name AS nation, c_mktsegment AS segment, sum(l_quantity) AS quantity, count(*) AS lines FROM sales
WHERE o_orderstatus = 'F' AND l_returnflag IN ('A', 'R') GROUP BY ALL HAVING count(*) > 20
ORDER BY quantity DESC, nation, segment LIMIT 25""")
def cube_filter_having_order(spark, folder):
    return sales_cube(spark, folder).query(
        CubeQuery(
            ("nation", "segment"), ("quantity", "lines"),
            filters={"status": "F", "returnflag": ["A", "R"]},
            having={"lines": "> 20"},
            order_by=("quantity desc", "nation", "segment"),
            limit=25,
        )
    )


@query("cube_dimensions_only", SALES + "SELECT DISTINCT r_name AS region, o_orderpriority AS priority FROM sales")
def cube_dimensions_only(spark, folder):
    return sales_cube(spark, folder).query(CubeQuery(("region", "priority")))


@query("cube_slice", SALES + """
SELECT o_orderpriority AS priority, round(sum(amount), 4) AS revenue FROM sales WHERE c_mktsegment = 'BUILDING' GROUP BY ALL""")
def cube_slice(spark, folder):
    step = olap.slice_by("segment", "BUILDING")
    return rounded(revenue_cube(spark, folder).query(step(CubeQuery(("segment", "priority"), ("revenue",)))), 4, "revenue")


@query("cube_dice", SALES + """
SELECT r_name AS region, c_mktsegment AS segment, round(sum(amount), 4) AS revenue FROM sales
WHERE r_name IN ('ASIA', 'EUROPE') AND c_mktsegment = 'MACHINERY' GROUP BY ALL""")
def cube_dice(spark, folder):
    step = olap.dice({"region": ["ASIA", "EUROPE"], "segment": "MACHINERY"})
    return rounded(revenue_cube(spark, folder).query(step(CubeQuery(("region", "segment"), ("revenue",)))), 4, "revenue")


@query("cube_drill_down", SALES + """
SELECT r_name AS geo_region, n_name AS geo_nation, order_year AS cal_year, sum(l_quantity) AS quantity FROM sales GROUP BY ALL""")
def cube_drill_down(spark, folder):
    steps = olap.in_sequence(olap.drill_down("geography", "geo_nation"), olap.drill_down("calendar", "cal_year"))
    return sales_cube(spark, folder).query(steps(CubeQuery(("geography",), ("quantity",))))


@query("cube_drill_up", SALES + """
SELECT r_name AS geo_region, order_year AS cal_year, order_month AS cal_month, sum(l_quantity) AS quantity FROM sales GROUP BY ALL""")
def cube_drill_up(spark, folder):
    steps = olap.in_sequence(
        olap.drill_down("calendar", "cal_month"), olap.drill_down("geography", "geo_nation"), olap.drill_up("geography", "geo_region")
    )
    return sales_cube(spark, folder).query(steps(CubeQuery(("geography",), ("quantity",))))


STATUSES = ["F", "O", "P"]


@query("cube_pivot_wide", SALES + """
SELECT r_name AS region, sum(l_quantity) FILTER (o_orderstatus = 'F') AS F, sum(l_quantity) FILTER (o_orderstatus = 'O') AS O,
  sum(l_quantity) FILTER (o_orderstatus = 'P') AS P FROM sales GROUP BY ALL""")
def cube_pivot_wide(spark, folder):
    cells = sales_cube(spark, folder).query(CubeQuery(("region", "status"), ("quantity",)))
    return olap.pivot_wide(cells, ["region"], "status", STATUSES, "quantity")


@query("cube_pivot_reorder", SALES + """
SELECT c_mktsegment AS segment, l_linestatus AS linestatus, r_name AS region, count(*) AS lines FROM sales GROUP BY ALL""")
def cube_pivot_reorder(spark, folder):
    step = olap.reorder(["segment", "linestatus"], ["region"])
    return sales_cube(spark, folder).query(step(CubeQuery(("region", "segment", "linestatus"), ("lines",))))


@query("cube_roll_up", SALES + "SELECT c_mktsegment AS segment, round(sum(amount), 4) AS revenue FROM sales GROUP BY ALL")
def cube_roll_up(spark, folder):
    start = CubeQuery(("region", "segment"), ("revenue",), filters={"region": "ASIA"})
    return rounded(revenue_cube(spark, folder).query(olap.roll_up("region")(start)), 4, "revenue")


@query("cube_filter_operation", SALES + """
SELECT l_linestatus AS linestatus, count(*) AS lines FROM sales WHERE o_orderpriority = '1-URGENT' GROUP BY ALL""")
def cube_filter_operation(spark, folder):
    step = olap.filter_by({"priority": "1-URGENT"})
    return sales_cube(spark, folder).query(step(CubeQuery(("linestatus",), ("lines",))))


@query("cube_bottom_n", SALES + """
SELECT n_name AS nation, sum(l_quantity) AS quantity FROM sales GROUP BY ALL ORDER BY 2, 1 LIMIT 5""")
def cube_bottom_n(spark, folder):
    return sales_cube(spark, folder).query(olap.top_n("quantity", 5, ascending=True)(CubeQuery(("nation",), ())))


@query("cube_sequence", SALES + """
SELECT r_name AS geo_region, n_name AS geo_nation, sum(l_quantity) AS quantity FROM sales
WHERE o_orderstatus = 'O' AND r_name IN ('ASIA', 'AFRICA') GROUP BY ALL ORDER BY quantity DESC, geo_region DESC LIMIT 7""")
def cube_sequence(spark, folder):
    steps = olap.in_sequence(
        olap.slice_by("status", "O"),
        olap.dice({"region": ["ASIA", "AFRICA"]}),
        olap.drill_down("geography", "geo_nation"),
        olap.top_n("quantity", 7),
    )
    return sales_cube(spark, folder).query(steps(CubeQuery(("status",), ("quantity",))))


@query("cube_null_filter", "SELECT o_orderstatus AS status, count(*) AS lines FROM orders WHERE o_orderpriority = NULL GROUP BY ALL")
def cube_null_filter(spark, folder):
    schema = CubeSchema("orders", (Dimension("status", "o_orderstatus"), Dimension("priority", "o_orderpriority")), (Measure("lines", "*", "count"),))
    return Cube(table(spark, folder, "orders"), schema).query(CubeQuery(("status",), ("lines",), filters={"priority": None}))


@query("cube_discovered", """
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS l_quantity, round(sum(l_extendedprice), 2) AS l_extendedprice,
  round(sum(l_discount), 2) AS l_discount, round(sum(l_tax), 2) AS l_tax, sum(l_linenumber)::BIGINT AS l_linenumber
FROM lineitem GROUP BY ALL""")
def cube_discovered(spark, folder):
    source = table(spark, folder, "lineitem")
    schema = olap.discover_schema(source, "lineitem")
    cube = Cube(source, schema)
    result = cube.query(CubeQuery(("l_returnflag", "l_linestatus"), tuple(m.name for m in schema.measures)))
    return rounded(result, 2, "l_extendedprice", "l_discount", "l_tax")


@query("cube_dimension_values", "SELECT DISTINCT o_orderpriority AS priority FROM orders WHERE o_orderpriority IS NOT NULL ORDER BY 1")
def cube_dimension_values(spark, folder):
    schema = CubeSchema("orders", (Dimension("priority", "o_orderpriority"),), ())
    return Cube(table(spark, folder, "orders"), schema).dimension_values("priority")


@query("cube_measure_summary", SALES + """
SELECT count(q) AS count, sum(q) AS sum, min(q) AS min, max(q) AS max, round(avg(q), 4) AS avg
FROM (SELECT n_name, c_mktsegment, sum(l_quantity) AS q FROM sales GROUP BY ALL)""")
def cube_measure_summary(spark, folder):
    cells = sales_cube(spark, folder).query(CubeQuery(("nation", "segment"), ("quantity",)))
    return rounded(olap.measure_summary(cells, "quantity"), 4, "avg")
