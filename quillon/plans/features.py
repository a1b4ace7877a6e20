"""Projection, filter and feature queries; catalog access."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillon.functions.paths import matches, nested, numeric
from quillon.operators import drift, features
from quillon.plans.joins import feature_values
from quillon.plans.registry import query, rounded, table
from quillon.session import checkpoint_folder
from quillon.sources import catalog


# -- catalog ------------------------------------------------------------------------------------


@query("parameter_query", """
SELECT o_orderpriority, count(*) AS orders FROM orders WHERE o_totalprice > 250000.0 AND o_orderstatus = 'F' GROUP BY ALL""")
def parameter_query(spark, folder):
    table(spark, folder, "orders").createOrReplaceTempView("quillon_orders")
    return catalog.run_query(
        spark,
        "SELECT o_orderpriority, count(*) AS orders FROM quillon_orders "
        "WHERE o_totalprice > :price AND o_orderstatus = :status GROUP BY o_orderpriority",
        {"price": 250000.0, "status": "F"},
    )


@query("table_sample", "SELECT least(count(*), 100) AS sampled, least(count(*), 100) AS known FROM customer")
def table_sample(spark, folder):
    """Which rows come is open, so the query counts them, and those that are in the table."""
    customers = table(spark, folder, "customer")
    customers.createOrReplaceTempView("quillon_customer")
    sample = catalog.sample_table(spark, "quillon_customer", limit=100)
    known = customers.select("c_custkey", F.lit(1).alias("known"))
    return sample.select("c_custkey").distinct().join(known, "c_custkey", "left").agg(
        F.count(F.lit(1)).alias("sampled"), F.count("known").alias("known")
    )


@query("table_info", """
SELECT column_index + 1 AS position, column_name AS "column",
  CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' ELSE 'timestamp_ntz' END AS data_type,
  true AS is_nullable, (SELECT count(*) FROM lineitem) AS row_count
FROM duckdb_columns() WHERE table_name = 'lineitem'""".replace("column_index + 1", "column_index"))
def table_info(spark, folder):
    return catalog.table_info(table(spark, folder, "lineitem"))


# -- paths and filters --------------------------------------------------------------------------


@query("nested_path", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, CAST(NULL AS VARCHAR) AS missing,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k_number FROM events""")
def nested_path(spark, folder):
    events = table(spark, folder, "events")
    return events.select(
        "event_id",
        nested(events, "props.k").alias("k"),
        nested(events, "props.a.b").cast("string").alias("missing"),
        numeric(events, "props.k").alias("k_number"),
    )


@query("subscription_filter", """
SELECT event_id, user_id FROM events WHERE event_type IN ('click', 'purchase') AND CAST(json_extract_string(props, '$.k') AS INTEGER) = 69""")
def subscription_filter(spark, folder):
    events = table(spark, folder, "events")
    return events.filter(matches(events, {"event_type": ["click", "purchase"], "props.k": "69"})).select("event_id", "user_id")


# -- expressions --------------------------------------------------------------------------------

EXPRESSIONS = {
    "net_price": "$l_extendedprice * (1 - $l_discount) * (1 + $l_tax)",
    "unit_price": "$l_extendedprice / $l_quantity",
    "quantity_tens": "$l_quantity // 10",
    "shifted_mod": "($l_quantity - 25) % 7",
    "log_price": "log($l_extendedprice)",
    "root": "sqrt($l_quantity - 25)",
    "power": "$l_discount ** 2",
    "larger": "max($l_quantity, $l_linenumber * 10, 15)",
    "half_even": "round($l_quantity / 2)",
    "wave": "abs(-sin($l_quantity)) + cos($l_tax)",
    "by_zero": "$l_quantity / ($l_linenumber - 1)",
}


@query("feature_expressions", """
SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 7) AS net_price,
  round(l_extendedprice / l_quantity, 9) AS unit_price, floor(l_quantity / 10) AS quantity_tens,
  (l_quantity - 25) - 7 * floor((l_quantity - 25) / 7) AS shifted_mod, round(ln(l_extendedprice), 6) AS log_price,
  CASE WHEN l_quantity >= 25 THEN round(sqrt(l_quantity - 25), 6) END AS root, round(l_discount ** 2, 6) AS power,
  greatest(l_quantity, l_linenumber * 10, 15) AS larger, round_even(l_quantity / 2, 0) AS half_even,
  round(abs(-sin(l_quantity)) + cos(l_tax), 6) AS wave,
  CASE WHEN l_linenumber > 1 THEN round(l_quantity / (l_linenumber - 1), 6) END AS by_zero
FROM lineitem""")
def feature_expressions(spark, folder):
    made = features.with_features(table(spark, folder, "lineitem"), EXPRESSIONS).select(
        "l_orderkey", "l_linenumber", *EXPRESSIONS
    )
    return rounded(rounded(made, 9, "unit_price").transform(lambda d: rounded(d, 6, "log_price", "root", "power", "wave", "by_zero")), 7, "net_price")


@query("event_features", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, event_type AS feature_event_type,
  'source-' || (user_id % 4) AS feature_source_service, hour(ts)::INTEGER AS timestamp_hour, (isodow(ts) - 1)::INTEGER AS timestamp_day_of_week FROM events""")
def event_features(spark, folder):
    events = table(spark, folder, "events").withColumn("service", F.concat(F.lit("source-"), F.col("user_id") % 4))
    made = features.event_features(events, {"k": "props.k"}, "event_type", "service", "ts")
    return made.select("event_id", "k", "feature_event_type", "feature_source_service", "timestamp_hour", "timestamp_day_of_week")


@query("feature_vector", """
SELECT event_id, value AS first, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0.0) AS second, 0.0::DOUBLE AS third FROM events""")
def feature_vector(spark, folder):
    events = table(spark, folder, "events")
    wide = events.withColumn("k", nested(events, "props.k"))
    vector = wide.select("event_id", features.feature_vector(["value", "k", "unknown"], wide.columns).alias("v"))
    return vector.select("event_id", *[F.col("v")[at].alias(name) for at, name in enumerate(("first", "second", "third"))])


@query("derived_features", """
WITH u AS (SELECT user_id, min(ts) AS s, max(ts) AS l, count(*) FILTER (event_type = 'view') AS v, avg(value) AS r,
  arg_min(event_type, ts) AS a, arg_max(event_type, ts) AS b FROM events GROUP BY user_id)
SELECT user_id, round((epoch_us(l) - epoch_us(s)) / 60000000.0, 6) AS session_minutes,
  round(v * 0.7 + r * 3, 9) AS popularity, CASE WHEN a = b THEN 1.0 ELSE 0.3 END::DOUBLE AS affinity,
  round((v * 0.7 + r * 3) * CASE WHEN a = b THEN 1.0 ELSE 0.3 END, 9) AS ranking FROM u""")
def derived_features(spark, folder):
    users = table(spark, folder, "events").groupBy("user_id").agg(
        F.min("ts").alias("session_start_time"),
        F.max("ts").alias("last_activity_time"),
        F.count_if(F.col("event_type") == "view").alias("view_count"),
        F.avg("value").alias("rating"),
        F.min_by("event_type", "ts").alias("user_category_preference"),
        F.max_by("event_type", "ts").alias("item_category"),
    )
    computers = {
        "ranking": (["popularity", "affinity"], lambda x: x["popularity"] * x["affinity"]),
        "session_minutes": (["session_start_time", "last_activity_time"], features.session_minutes),
        "popularity": (["view_count", "rating"], features.popularity_score),
        "affinity": (["user_category_preference", "item_category"], features.affinity_score),
    }
    made = features.derived_features(users, computers, ["ranking", "session_minutes", "popularity", "affinity"])
    made = made.select("user_id", "session_minutes", "popularity", "affinity", "ranking")
    return rounded(rounded(made, 6, "session_minutes"), 9, "popularity", "ranking")


# -- feature rows and catalog -------------------------------------------------------------------


@query("feature_rows", """
SELECT CAST(c_custkey AS VARCHAR) AS entity_id, 'balance' AS feature_name, round(c_acctbal, 6) AS value, TIMESTAMP '2024-01-01' AS timestamp FROM customer
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'balance_k', round(c_acctbal / 1000, 6), TIMESTAMP '2024-01-01' FROM customer""")
def feature_rows(spark, folder):
    rows = features.feature_rows(
        table(spark, folder, "customer"), {"balance": "$c_acctbal", "balance_k": "$c_acctbal / 1000"},
        F.lit("2024-01-01").cast("timestamp_ntz"),
    )
    return rows.withColumn("value", F.round(F.col("value").cast("double"), 6))


@query("feature_null_shares", """
SELECT event_type AS feature_name, count(*) AS value_count, round(avg(CASE WHEN value > 150 THEN 1.0 ELSE 0.0 END), 8) AS null_share,
  avg(CASE WHEN value > 150 THEN 1.0 ELSE 0.0 END) <= 0.05 AS is_valid FROM events GROUP BY ALL""")
def feature_null_shares(spark, folder):
    rows = table(spark, folder, "events").select(
        F.col("event_type").alias("feature_name"), F.when(F.col("value") <= 150, F.col("value")).alias("value")
    )
    return rounded(features.null_shares(rows, 0.05), 8, "null_share")


@query("feature_rule_checks", """
WITH d AS (SELECT event_type, event_id, value, CASE WHEN event_id % 11 = 0 THEN '"text"' ELSE CAST(value AS VARCHAR) END AS v FROM events),
x AS (SELECT event_type AS feature_name, event_id, CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END AS bad_type,
  CASE WHEN event_id % 11 <> 0 AND value < 1 THEN 1 ELSE 0 END AS low, CASE WHEN event_id % 11 <> 0 AND value > 100 THEN 1 ELSE 0 END AS high FROM d)
SELECT feature_name, count(*) FILTER (bad_type + low + high = 0) AS valid, sum(bad_type)::BIGINT AS bad_type, sum(low)::BIGINT AS low, sum(high)::BIGINT AS high
FROM x GROUP BY ALL""")
def feature_rule_checks(spark, folder):
    events = table(spark, folder, "events")
    rows = events.select(
        F.col("event_type").alias("feature_name"),
        F.when(F.col("event_id") % 11 == 0, F.lit('"text"')).otherwise(F.col("value").cast("string")).alias("value"),
    )
    definitions = events.select(F.col("event_type").alias("feature_name")).distinct().select(
        "feature_name",
        F.lit("float").alias("feature_type"),
        F.lit(1.0).alias("min_value"),
        F.lit(100.0).alias("max_value"),
        F.lit(3).alias("max_length"),
    )
    checked = features.validate_values(rows, definitions)
    has = lambda text: F.count_if(F.array_contains("errors", text))
    return checked.groupBy("feature_name").agg(
        F.count_if("is_valid").alias("valid"),
        has("expected float").alias("bad_type"),
        has("below minimum").alias("low"),
        has("above maximum").alias("high"),
    )


DEFINITIONS = """
WITH d AS (SELECT p_partkey, p_type AS feature_type, p_brand AS owner, string_split(p_name, ' ') AS tags,
  TIMESTAMP '2024-01-31' - to_days(CAST(p_size AS INTEGER)) AS created_at FROM part)
"""


def definitions(spark, folder):
    return table(spark, folder, "part").select(
        "p_partkey",
        F.col("p_type").alias("feature_type"),
        F.col("p_brand").alias("owner"),
        F.split("p_name", " ").alias("tags"),
        (F.lit("2024-01-31").cast("timestamp") - F.make_dt_interval(days=F.col("p_size"))).alias("created_at"),
    )


@query("catalog_by_type", DEFINITIONS + """
SELECT t AS feature_type, count(p_partkey) AS feature_count FROM (VALUES ('PROMO'), ('LARGE'), ('UNUSED')) x(t) LEFT JOIN d ON feature_type = t GROUP BY t""")
def catalog_by_type(spark, folder):
    return features.catalog_counts(definitions(spark, folder), "feature_type", ["PROMO", "LARGE", "UNUSED"])


@query("catalog_recent", DEFINITIONS + """
SELECT count(*) AS total, count(*) FILTER (created_at > TIMESTAMP '2024-01-31' - INTERVAL 7 DAY) AS recent FROM d""")
def catalog_recent(spark, folder):
    return features.recent_counts(definitions(spark, folder), "2024-01-31", 7)


@query("catalog_listing", DEFINITIONS + """
SELECT p_partkey, owner FROM d WHERE feature_type = 'PROMO' AND owner IN ('Brand#2') AND list_has_any(tags, ['ring', 'blue'])""")
def catalog_listing(spark, folder):
    listed = features.list_features(definitions(spark, folder), "PROMO", "Brand#2", ["ring", "blue"])
    return listed.select("p_partkey", "owner")


@query("feature_retention", """
SELECT CAST(user_id AS VARCHAR) AS entity_id, event_type AS feature_name, ts AS created_at FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 10 DAY""")
def feature_retention(spark, folder):
    kept = features.retained(feature_values(spark, folder), "2024-01-31", 10)
    return kept.select("entity_id", "feature_name", "created_at")


@query("feature_retention_applied", """
SELECT CAST(user_id AS VARCHAR) AS entity_id, event_type AS feature_name, ts AS created_at, (SELECT count(*) FROM events WHERE ts < TIMESTAMP '2024-01-31 12:00:00' - INTERVAL 10 DAY) AS removed
FROM events WHERE ts >= TIMESTAMP '2024-01-31 12:00:00' - INTERVAL 10 DAY""")
def feature_retention_applied(spark, folder):
    """The values of a store by day after retention; its limit falls into the middle of a day."""
    store = f"{checkpoint_folder(spark)}/store-{uuid.uuid4().hex}"
    features.stored_by_day(feature_values(spark, folder).select("entity_id", "feature_name", "created_at"), store)
    removed = features.apply_retention(spark, store, "2024-01-31 12:00:00", 10)
    return spark.read.parquet(store).select("entity_id", "feature_name", "created_at", F.lit(removed).cast("long").alias("removed"))


@query("feature_freshness", """
SELECT event_type AS feature_name, CAST(user_id AS VARCHAR) AS entity_id, max(ts) AS newest,
  (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(max(ts))) / 1000000.0 AS age_seconds,
  epoch_us(TIMESTAMP '2024-01-31') - epoch_us(max(ts)) <= 86400000000 AS is_fresh FROM events GROUP BY ALL""")
def feature_freshness(spark, folder):
    return features.freshness(feature_values(spark, folder), "2024-01-31", 86_400)


# -- feature monitoring -------------------------------------------------------------------------

HALVES = """
WITH base AS (SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-16'), cur AS (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-16')
"""


def halves(spark, folder):
    """Events before and after the middle of the month."""
    events = table(spark, folder, "events")
    middle = F.lit("2024-01-16").cast("timestamp_ntz")
    return events.filter(F.col("ts") < middle), events.filter(F.col("ts") >= middle)


def _numbers(df):
    return df.select(F.col("event_type").alias("feature_name"), F.col("value").cast("string").alias("value"))


def _categories(df):
    return drift.long_features(df.withColumn("digit", F.substring(nested(df, "props.k"), 1, 1)), ["event_type", "digit"])


@query("numeric_baseline", """
WITH r AS (SELECT event_type, value, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n
  FROM events WINDOW w AS (PARTITION BY event_type ORDER BY value))
SELECT event_type AS feature_name, count(*) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
  min(value) AS min_val, max(value) AS max_val, 0.0::DOUBLE AS null_percentage, count(DISTINCT value) AS unique_values,
  max(value) FILTER (i = floor(0.25 * (n - 1))) AS p25, max(value) FILTER (i = floor(0.5 * (n - 1))) AS p50,
  max(value) FILTER (i = floor(0.75 * (n - 1))) AS p75, max(value) FILTER (i = floor(0.9::DOUBLE * (n - 1))) AS p90,
  max(value) FILTER (i = floor(0.95::DOUBLE * (n - 1))) AS p95, max(value) FILTER (i = floor(0.99::DOUBLE * (n - 1))) AS p99
FROM r GROUP BY event_type""")
def numeric_baseline(spark, folder):
    return rounded(drift.numeric_baseline(_numbers(table(spark, folder, "events"))), 6, "mean", "std")


CATEGORIES = HALVES + """
, b AS (SELECT 'event_type' AS f, event_type AS c FROM base UNION ALL SELECT 'digit', substr(json_extract_string(props, '$.k'), 1, 1) FROM base),
n AS (SELECT 'event_type' AS f, event_type AS c FROM cur UNION ALL SELECT 'digit', substr(json_extract_string(props, '$.k'), 1, 1) FROM cur),
bc AS (SELECT f, c, count(*) AS x, sum(count(*)) OVER (PARTITION BY f) AS t FROM b GROUP BY f, c),
nc AS (SELECT f, c, count(*) AS x, sum(count(*)) OVER (PARTITION BY f) AS t FROM n GROUP BY f, c),
s AS (SELECT f, c, coalesce(bc.x, 0) AS xb, coalesce(nc.x, 0) AS xn, max(bc.t) OVER w AS tb, max(nc.t) OVER w AS tn
  FROM bc FULL JOIN nc USING (f, c) WINDOW w AS (PARTITION BY f)),
p AS (SELECT *, xb / tb AS pb, xn / tn AS pn FROM s)
"""


@query("categorical_baseline", CATEGORIES + "SELECT f AS feature_name, c AS category, x AS n FROM bc")
def categorical_baseline(spark, folder):
    return drift.categorical_baseline(_categories(halves(spark, folder)[0]))


@query("numeric_drift", HALVES + """
, m AS (SELECT event_type, avg(value) AS a, stddev_samp(value) AS s FROM base GROUP BY ALL),
n AS (SELECT event_type, avg(value) AS b, stddev_samp(value) AS r FROM cur GROUP BY ALL)
SELECT event_type AS feature_name, round(a, 6) AS mean_base, round(b, 6) AS mean_now, round(s, 6) AS std_base, round(r, 6) AS std_now,
  round(abs(b - a), 6) AS mean_shift, round(r / s, 6) AS std_ratio, round(least((abs(b - a) + abs(r - s)) / (2 * s), 1.0), 6) AS drift_score
FROM m JOIN n USING (event_type)""")
def numeric_drift(spark, folder):
    base, now = halves(spark, folder)
    made = drift.numeric_drift(drift.numeric_baseline(_numbers(base)), drift.numeric_baseline(_numbers(now)))
    return rounded(made, 6, *[c for c in made.columns if c != "feature_name"])


@query("categorical_drift", CATEGORIES + """
SELECT f AS feature_name, round(least(sum((greatest(pn, 1e-6) - greatest(pb, 1e-6)) * ln(greatest(pn, 1e-6) / greatest(pb, 1e-6))), 1.0), 8) AS drift_score,
  count(*) FILTER (xb = 0) AS new_categories, count(*) FILTER (xn = 0) AS missing_categories FROM p GROUP BY f""")
def categorical_drift(spark, folder):
    base, now = halves(spark, folder)
    return rounded(drift.categorical_drift(_categories(base), _categories(now)), 8, "drift_score")


@query("drift_status", """
WITH d AS (SELECT event_id, value / 100 AS drift_score FROM events)
SELECT event_id, drift_score, CASE WHEN drift_score >= 0.5 THEN 'high_drift' WHEN drift_score >= 0.3 THEN 'medium_drift' WHEN drift_score >= 0.1 THEN 'low_drift' ELSE 'no_drift' END AS drift_status,
  CASE WHEN drift_score >= 0.5 THEN 'error' WHEN drift_score >= 0.1 THEN 'warning' END AS alert_level FROM d""")
def drift_status(spark, folder):
    scores = table(spark, folder, "events").select("event_id", (F.col("value") / 100).alias("drift_score"))
    return drift.with_drift_status(scores)


@query("drift_history", """
SELECT event_id, ts AS created_at, value AS drift_score FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-31' - INTERVAL 5 DAY""")
def drift_history(spark, folder):
    found = table(spark, folder, "events").select(
        "event_id", F.col("event_type").alias("feature_name"), F.col("ts").alias("created_at"), F.col("value").alias("drift_score")
    )
    return drift.drift_history(found, "click", "2024-01-31", 5).drop("feature_name")


@query("drift_alerts_stored", """
SELECT event_id AS id, ts AS created_at FROM events WHERE event_type = 'view' AND value > 60 AND event_id % 3 <> 0""")
def drift_alerts_stored(spark, folder):
    stored = table(spark, folder, "events").select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("feature_name"),
        F.when(F.col("value") > 60, "error").otherwise("warning").alias("alert_level"),
        (F.col("event_id") % 3 == 0).alias("acknowledged"),
        F.col("ts").alias("created_at"),
    )
    return drift.find_alerts(stored, "view", "error", False).select("id", "created_at")
