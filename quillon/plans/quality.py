"""Quality suites, profiles and quality alerts over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import alerts, profiling, quality
from quillon.plans.registry import query, rounded, table

LINE_COLUMNS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate",
]


def expect(kind, **kwargs):
    return {"expectation_type": f"expect_{kind}", "kwargs": kwargs}


LINE_SUITE = [
    expect("table_row_count_to_be_between", min_value=1, max_value=1000),
    expect("table_columns_to_match_ordered_list", column_list=LINE_COLUMNS),
    expect("column_to_exist", column="l_tax"),
    expect("column_to_exist", column="l_colour"),
    expect("column_values_to_not_be_null", column="l_shipdate"),
    expect("column_values_to_be_unique", column="l_orderkey"),
    expect("column_values_to_be_between", column="l_discount", min_value=0, max_value=0.05),
    expect("column_values_to_be_in_set", column="l_returnflag", value_set=["A", "N"]),
    expect("column_values_to_not_be_null", column="l_colour"),
    expect("column_values_to_be_pretty", column="l_tax"),
]
LINE_RESULTS = """
WITH m AS (SELECT count(*) AS n, count(*) - count(DISTINCT l_orderkey) AS dup, count(*) - count(l_shipdate) AS nul,
  count(*) FILTER (l_discount > 0.05 OR l_discount < 0) AS disc, count(*) FILTER (l_returnflag NOT IN ('A', 'N')) AS flag FROM lineitem),
r AS (SELECT unnest([
  {'check_no': 0, 'expectation_type': 'expect_table_row_count_to_be_between', 'success': n <= 1000, 'observed': n::DOUBLE},
  {'check_no': 1, 'expectation_type': 'expect_table_columns_to_match_ordered_list', 'success': true, 'observed': 11::DOUBLE},
  {'check_no': 2, 'expectation_type': 'expect_column_to_exist', 'success': true, 'observed': 1::DOUBLE},
  {'check_no': 3, 'expectation_type': 'expect_column_to_exist', 'success': false, 'observed': 0::DOUBLE},
  {'check_no': 4, 'expectation_type': 'expect_column_values_to_not_be_null', 'success': nul = 0, 'observed': nul::DOUBLE},
  {'check_no': 5, 'expectation_type': 'expect_column_values_to_be_unique', 'success': dup = 0, 'observed': dup::DOUBLE},
  {'check_no': 6, 'expectation_type': 'expect_column_values_to_be_between', 'success': disc = 0, 'observed': disc::DOUBLE},
  {'check_no': 7, 'expectation_type': 'expect_column_values_to_be_in_set', 'success': flag = 0, 'observed': flag::DOUBLE},
  {'check_no': 8, 'expectation_type': 'expect_column_values_to_not_be_null', 'success': false, 'observed': NULL::DOUBLE},
  {'check_no': 9, 'expectation_type': 'expect_column_values_to_be_pretty', 'success': false, 'observed': NULL::DOUBLE}], recursive := true) FROM m)
"""


@query("quality_suite", LINE_RESULTS + "SELECT * FROM r")
def quality_suite(spark, folder):
    results = quality.run_suite(table(spark, folder, "lineitem"), LINE_SUITE)
    return results.select("check_no", "expectation_type", "success", "observed")


@query("quality_suite_summary", LINE_RESULTS + """
SELECT 'lineitem' AS dataset_name, count(*) AS expectations_count, count(*) FILTER (success) AS success_count,
  count(*) FILTER (NOT success) AS failure_count, round(avg(CASE WHEN success THEN 1.0 ELSE 0.0 END), 8) AS success_rate, bool_and(success) AS success,
  string_agg(DISTINCT CASE WHEN NOT success THEN expectation_type END, ',' ORDER BY CASE WHEN NOT success THEN expectation_type END) AS failed_types FROM r""")
def quality_suite_summary(spark, folder):
    results = quality.run_suite(table(spark, folder, "lineitem"), LINE_SUITE)
    summary = quality.suite_summary(results, "lineitem")
    return rounded(summary.withColumn("failed_types", F.array_join("failed_types", ",")), 8, "success_rate")


@query("quality_common_suite", """
SELECT row_number() OVER () - 1 AS check_no, t AS expectation_type, true AS success FROM (VALUES
  (1, 'expect_table_columns_to_match_ordered_list'), (2, 'expect_table_row_count_to_be_between'), (3, 'expect_column_to_exist'), (4, 'expect_column_to_exist'),
  (5, 'expect_column_to_exist'), (6, 'expect_column_to_exist'), (7, 'expect_column_to_exist'), (8, 'expect_column_values_to_not_be_null'), (9, 'expect_column_values_to_be_unique'),
  (10, 'expect_column_values_to_not_be_null'), (11, 'expect_column_values_to_be_unique')) x(i, t)
WHERE (SELECT count(DISTINCT c_custkey) = count(*) AND count(DISTINCT c_name) = count(*) AND count(c_mktsegment) = count(*) FROM customer)""")
def quality_common_suite(spark, folder):
    customers = table(spark, folder, "customer")
    suite = quality.common_expectations(customers.columns, ["c_custkey"], ["c_mktsegment"], ["c_name"])
    return quality.run_suite(customers, suite).select(F.col("check_no").cast("long").alias("check_no"), "expectation_type", "success")


# -- profiles -----------------------------------------------------------------------------------


@query("profile_table", """
WITH d AS (SELECT event_id // 2 AS pair, ts - INTERVAL 1 MICROSECOND * (event_id % 3) AS ts, user_id, event_type, value, props FROM events
  UNION ALL SELECT event_id // 2, ts, user_id, event_type, value, props FROM events)
SELECT count(*) AS row_count, 6 AS column_count, 0::BIGINT AS missing_cells, 0.0::DOUBLE AS missing_cells_percentage,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM d)) AS duplicate_rows,
  round((count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM d))) * 100.0 / count(*), 6) AS duplicate_rows_percentage FROM d""")
def profile_table(spark, folder):
    """Every event twice, two in three of the copies some microseconds apart."""
    events = table(spark, folder, "events").withColumn("pair", F.floor(F.col("event_id") / 2))
    columns = ["pair", "ts", "user_id", "event_type", "value", "props"]
    moved = events.withColumn("ts", F.expr("timestampadd(MICROSECOND, -int(event_id % 3), ts)"))
    rows = moved.select(columns).unionAll(events.select(columns))
    return rounded(profiling.table_profile(rows), 6, "duplicate_rows_percentage")


@query("profile_table_documents", """
SELECT count(*) AS row_count, 4 AS column_count, count(*) FILTER (n IS NULL) AS missing_cells, round(count(*) FILTER (n IS NULL) * 25.0 / count(*), 6) AS missing_cells_percentage,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang, source, CASE WHEN n_chars % 10 <> 0 THEN n_chars END FROM documents)) AS duplicate_rows,
  round((count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang, source, CASE WHEN n_chars % 10 <> 0 THEN n_chars END FROM documents))) * 100.0 / count(*), 6) AS duplicate_rows_percentage
FROM (SELECT *, CASE WHEN n_chars % 10 <> 0 THEN n_chars END AS n FROM documents)""")
def profile_table_documents(spark, folder):
    rows = table(spark, folder, "documents").select(
        "text", "lang", "source", F.when(F.col("n_chars") % 10 != 0, F.col("n_chars")).alias("n")
    )
    return rounded(profiling.table_profile(rows), 6, "missing_cells_percentage", "duplicate_rows_percentage")


def _column_profile_sql(source, columns):
    parts = [
        f"""SELECT '{name}' AS "column", '{dtype}' AS dtype, {name}::VARCHAR AS k, {name}::VARCHAR AS v FROM {source}"""
        for name, dtype in columns
    ]
    return f"""
WITH l AS ({' UNION ALL '.join(parts)}),
c AS (SELECT "column", dtype, k, min(v) AS v, count(*) AS n FROM l WHERE k IS NOT NULL GROUP BY ALL),
t AS (SELECT "column", dtype, count(*) AS row_count, count(*) - count(k) AS missing_count, count(DISTINCT k) AS unique_count FROM l GROUP BY ALL),
b AS (SELECT "column", v AS most_frequent_value, n AS most_frequent_count FROM c QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY n DESC, k) = 1)
SELECT "column", dtype, missing_count, round(missing_count * 100.0 / row_count, 6) AS missing_percentage, unique_count,
  round(unique_count * 100.0 / row_count, 6) AS unique_percentage, most_frequent_value, most_frequent_count, row_count FROM t LEFT JOIN b USING ("column")"""


DOCUMENT_COLUMNS = [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint")]


@query("profile_columns_documents", _column_profile_sql("documents", DOCUMENT_COLUMNS))
def profile_columns_documents(spark, folder):
    return rounded(profiling.column_profile(table(spark, folder, "documents")), 6, "missing_percentage", "unique_percentage")


ORDER_COLUMNS = [
    ("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("priority", "string"),
]


@query("profile_columns_orders", _column_profile_sql(
    "(SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority END AS priority FROM orders)", ORDER_COLUMNS))
def profile_columns_orders(spark, folder):
    rows = table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority")).alias("priority")
    )
    return rounded(profiling.column_profile(rows), 6, "missing_percentage", "unique_percentage")


NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_linenumber"]
_LONG = " UNION ALL ".join(f"""SELECT '{c}' AS "column", {c}::DOUBLE AS v FROM lineitem""" for c in NUMERIC)


@query("profile_numeric", f"""
WITH l AS ({_LONG}),
q AS (SELECT "column", quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM l GROUP BY ALL)
SELECT "column", count(*) AS count, min(v) AS min, max(v) AS max, round(avg(v), 4) AS mean, round(any_value(median), 6) AS median, round(stddev_samp(v), 4) AS std,
  round(var_samp(v) / (avg(v) * avg(v)), 6) AS variance_ratio, round(skewness(v), 6) AS skewness, round(kurtosis(v), 6) AS kurtosis,
  round(any_value(q1), 6) AS q1, round(any_value(q3), 6) AS q3, round(any_value(q3 - q1), 6) AS iqr, count(*) FILTER (v = 0) AS zeros_count,
  round(count(*) FILTER (v = 0) * 100.0 / count(*), 6) AS zeros_percentage, count(*) FILTER (v < 0) AS negative_count, round(count(*) FILTER (v < 0) * 100.0 / count(*), 6) AS negative_percentage,
  count(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS outliers_count,
  round(count(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) * 100.0 / count(*), 6) AS outliers_percentage
FROM l JOIN q USING ("column") GROUP BY "column" """)
def profile_numeric(spark, folder):
    made = profiling.numeric_profile(table(spark, folder, "lineitem"), NUMERIC)
    made = made.withColumn("variance_ratio", F.col("variance") / (F.col("mean") * F.col("mean"))).drop("variance")
    made = rounded(made, 6, "variance_ratio", "median", "skewness", "kurtosis", "q1", "q3", "iqr", "zeros_percentage", "negative_percentage", "outliers_percentage")
    return rounded(made, 4, "mean", "std")


@query("profile_outliers", """
WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
SELECT 'value' AS "column", count(*) FILTER (value > q3 + 1.5 * (q3 - q1) OR value < q1 - 1.5 * (q3 - q1)) AS outliers_count FROM events, q""")
def profile_outliers(spark, folder):
    return profiling.numeric_profile(table(spark, folder, "events"), ["value"]).select("column", "outliers_count")


@query("profile_time", """
SELECT 'l_shipdate' AS "column", min(l_shipdate) AS min, max(l_shipdate) AS max, floor((epoch_us(max(l_shipdate)) - epoch_us(min(l_shipdate))) / 86400000000)::BIGINT AS range_days FROM lineitem""")
def profile_time(spark, folder):
    return profiling.time_profile(table(spark, folder, "lineitem"))


@query("profile_text", """
SELECT 'text' AS "column", min(length(text)) AS min_length, max(length(text)) AS max_length, round(avg(length(text)), 6) AS avg_length FROM documents
UNION ALL SELECT 'lang', min(length(lang)), max(length(lang)), round(avg(length(lang)), 6) FROM documents
UNION ALL SELECT 'source', min(length(source)), max(length(source)), round(avg(length(source)), 6) FROM documents""")
def profile_text(spark, folder):
    return rounded(profiling.text_profile(table(spark, folder, "documents")), 6, "avg_length")


@query("profile_top_categories", """
WITH l AS (SELECT 'source' AS "column", source AS v FROM documents UNION ALL SELECT 'lang', lang FROM documents UNION ALL SELECT 'text', text FROM documents),
c AS (SELECT "column", v AS value, v AS k, count(*) AS n FROM l GROUP BY "column", v)
SELECT "column", row_number() OVER (PARTITION BY "column" ORDER BY n DESC, k)::INTEGER AS rank, value, n AS count FROM c
QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY n DESC, k) <= 10""")
def profile_top_categories(spark, folder):
    return profiling.top_categories(table(spark, folder, "documents"))


CORRELATION = """
SELECT 'l_quantity' AS column1, 'l_extendedprice' AS column2, round(corr(l_quantity, l_extendedprice), 8) AS correlation FROM lineitem
UNION ALL SELECT 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 8) FROM lineitem
UNION ALL SELECT 'l_quantity', 'gross', round(corr(l_quantity, l_extendedprice * (1 + l_tax)), 8) FROM lineitem
UNION ALL SELECT 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount), 8) FROM lineitem
UNION ALL SELECT 'l_extendedprice', 'gross', round(corr(l_extendedprice, l_extendedprice * (1 + l_tax)), 8) FROM lineitem
UNION ALL SELECT 'l_discount', 'gross', round(corr(l_discount, l_extendedprice * (1 + l_tax)), 8) FROM lineitem"""


def _correlations(spark, folder):
    rows = table(spark, folder, "lineitem").withColumn("gross", F.col("l_extendedprice") * (1 + F.col("l_tax")))
    return profiling.correlations(rows, ["l_quantity", "l_extendedprice", "l_discount", "gross"])


@query("profile_correlations", CORRELATION)
def profile_correlations(spark, folder):
    return rounded(_correlations(spark, folder), 8, "correlation")


@query("profile_high_correlations", f"SELECT * FROM ({CORRELATION}) WHERE abs(correlation) >= 0.8")
def profile_high_correlations(spark, folder):
    return rounded(profiling.high_correlations(_correlations(spark, folder)), 8, "correlation")


@query("profile_warnings", """
WITH d AS (SELECT doc_id, 'one' AS fixed, CASE WHEN doc_id % 4 = 0 THEN lang END AS lang FROM documents)
SELECT 'high_missing' AS kind, NULL AS "column", round(count(*) FILTER (lang IS NULL) * 100.0 / (count(*) * 4), 6) + 25 AS value FROM d
UNION ALL SELECT 'all_missing', 'nothing', 0 UNION ALL SELECT 'single_value', 'fixed', 1
UNION ALL SELECT 'high_cardinality', 'doc_id', count(DISTINCT doc_id) FROM d""")
def profile_warnings(spark, folder):
    rows = table(spark, folder, "documents").select(
        "doc_id", F.lit("one").alias("fixed"), F.when(F.col("doc_id") % 4 == 0, F.col("lang")).alias("lang"), F.lit(None).cast("string").alias("nothing")
    )
    return rounded(profiling.profile_warnings(profiling.table_profile(rows), profiling.column_profile(rows)), 6, "value")


def _two_profiles(spark, folder):
    orders = table(spark, folder, "orders")
    first = orders.filter(F.col("o_orderstatus") == "F").select("o_custkey", "o_orderpriority", "o_totalprice")
    second = orders.filter(F.col("o_orderstatus") == "O").select(
        "o_custkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("o_orderpriority"), "o_orderstatus"
    )
    return first, second


@query("profile_comparison", """
WITH a AS (SELECT count(*) AS n, count(DISTINCT o_custkey) AS c, count(DISTINCT o_orderpriority) AS p FROM orders WHERE o_orderstatus = 'F'),
b AS (SELECT count(*) AS n, count(DISTINCT o_custkey) AS c, count(DISTINCT CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END) AS p,
  count(*) FILTER (o_orderkey % 5 = 0) AS m FROM orders WHERE o_orderstatus = 'O')
SELECT 'o_custkey' AS "column", 'common' AS status, 0.0::DOUBLE AS missing_percentage_change, round(b.c * 100.0 / b.n - a.c * 100.0 / a.n, 6) AS unique_percentage_change, false AS warned FROM a, b
UNION ALL SELECT 'o_orderpriority', 'common', round(m * 100.0 / b.n, 6), round(b.p * 100.0 / b.n - a.p * 100.0 / a.n, 6), true FROM a, b
UNION ALL SELECT 'o_orderstatus', 'new', NULL, NULL, true UNION ALL SELECT 'o_totalprice', 'removed', NULL, NULL, true""")
def profile_comparison(spark, folder):
    first, second = _two_profiles(spark, folder)
    made = profiling.compare_columns(profiling.column_profile(first), profiling.column_profile(second))
    return rounded(made, 6, "missing_percentage_change", "unique_percentage_change")


@query("profile_comparison_totals", """
WITH a AS (SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT count(*) AS n, count(*) FILTER (o_orderkey % 5 = 0) AS m FROM orders WHERE o_orderstatus = 'O'),
d AS (SELECT count(*) AS u FROM (SELECT DISTINCT o_custkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END FROM orders WHERE o_orderstatus = 'O')),
e AS (SELECT count(*) AS u FROM (SELECT DISTINCT o_custkey, o_orderpriority, o_totalprice FROM orders WHERE o_orderstatus = 'F'))
SELECT b.n - a.n AS row_count_change, 0::BIGINT AS column_count_change, round(m * 100.0 / (3 * b.n), 6) AS missing_cells_percentage_change,
  round((b.n - d.u) * 100.0 / b.n - (a.n - e.u) * 100.0 / a.n, 6) AS duplicate_rows_percentage_change FROM a, b, d, e""")
def profile_comparison_totals(spark, folder):
    first, second = _two_profiles(spark, folder)
    made = profiling.compare_tables(profiling.table_profile(first), profiling.table_profile(second))
    return rounded(made, 6, "missing_cells_percentage_change", "duplicate_rows_percentage_change")


INPUTS = """
WITH i AS (SELECT value, CASE WHEN event_id % 6 <> 0 THEN user_id END AS user_id, event_type FROM events),
q AS (SELECT quantile_cont(value, 0.25) AS v1, quantile_cont(value, 0.75) AS v3, quantile_cont(user_id, 0.25) AS u1, quantile_cont(user_id, 0.75) AS u3 FROM i),
s AS (SELECT 'value' AS "column", 0.0 AS missing_share, count(*) FILTER (value < v1 - 1.5 * (v3 - v1) OR value > v3 + 1.5 * (v3 - v1)) / count(*) AS outlier_share FROM i, q
  UNION ALL SELECT 'user_id', count(*) FILTER (user_id IS NULL) / count(*), count(*) FILTER (user_id < u1 - 1.5 * (u3 - u1) OR user_id > u3 + 1.5 * (u3 - u1)) / count(*) FROM i, q
  UNION ALL SELECT 'event_type', 0.0, NULL)
"""


def _inputs(spark, folder):
    return table(spark, folder, "events").select(
        "value", F.when(F.col("event_id") % 6 != 0, F.col("user_id")).alias("user_id"), "event_type"
    )


@query("input_quality", INPUTS + """
SELECT "column", round(missing_share, 8) AS missing_share, round(outlier_share, 8) AS outlier_share, missing_share > 0.1 AS high_missing, coalesce(outlier_share > 0.05, false) AS high_outliers FROM s""")
def input_quality(spark, folder):
    return rounded(profiling.input_quality(_inputs(spark, folder)), 8, "missing_share", "outlier_share")


@query("input_quality_score", INPUTS + "SELECT round(((1 - avg(missing_share)) + (1 - avg(outlier_share))) / 2, 8) AS overall_score FROM s")
def input_quality_score(spark, folder):
    return rounded(profiling.quality_score(profiling.input_quality(_inputs(spark, folder))), 8, "overall_score")


# -- alerts -------------------------------------------------------------------------------------


def _suite_history(spark, folder):
    """One suite summary per day of the events: how many of its checks hold."""
    daily = table(spark, folder, "events").groupBy(F.to_date("ts").alias("day")).agg(
        F.count_if(F.col("value") > 150).alias("extremes"), F.count(F.lit(1)).alias("rows")
    )
    return daily.select(
        F.concat(F.lit("day-"), F.col("day").cast("string")).alias("dataset_name"),
        (1 - F.col("extremes") / F.col("rows")).alias("success_rate"),
        F.col("extremes").alias("failure_count"),
        F.when(F.col("extremes") % 2 == 0, F.array(F.lit("expect_column_values_to_be_unique"))).otherwise(F.array().cast("array<string>")).alias("failed_types"),
    )


@query("quality_alerts", """
WITH d AS (SELECT 'day-' || CAST(ts AS DATE) AS dataset_name, count(*) FILTER (value > 150) AS x, count(*) AS n FROM events GROUP BY CAST(ts AS DATE))
SELECT dataset_name, 'low_success_rate' AS rule_id, 'high' AS severity FROM d WHERE (1 - x / n) * 100 < 95
UNION ALL SELECT dataset_name, 'multiple_failures', 'medium' FROM d WHERE x > 5
UNION ALL SELECT dataset_name, 'critical_expectations', 'critical' FROM d WHERE x % 2 = 0""")
def quality_alerts(spark, folder):
    raised = alerts.quality_alerts(_suite_history(spark, folder), alerts.default_rules())
    return raised.select("dataset_name", "rule_id", "severity")


@query("alert_cooldown", """
WITH RECURSIVE a AS (SELECT event_type AS rule_id, user_id % 3 AS dataset, ts, event_id FROM events),
e AS (SELECT rule_id, dataset, min(ts) AS ts FROM a GROUP BY ALL
  UNION ALL SELECT rule_id, dataset, next FROM (SELECT e.rule_id, e.dataset, (SELECT min(ts) FROM a WHERE a.rule_id = e.rule_id AND a.dataset = e.dataset AND a.ts >= e.ts + INTERVAL 4 HOUR) AS next FROM e) WHERE next IS NOT NULL)
SELECT a.event_id, a.rule_id, a.dataset, e.ts IS NOT NULL AS emitted FROM a LEFT JOIN e ON a.rule_id = e.rule_id AND a.dataset = e.dataset AND a.ts = e.ts""")
def alert_cooldown(spark, folder):
    log = table(spark, folder, "events").select(
        "event_id", F.col("event_type").alias("rule_id"), (F.col("user_id") % 3).alias("dataset"), "ts", F.lit(240).alias("minutes")
    )
    return alerts.with_cooldown(log, ["rule_id", "dataset"], "ts", "minutes", "event_id").drop("ts", "minutes")
