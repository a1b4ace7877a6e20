"""Unions and joins across sources, and reads at a point in time."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import features, federation
from quillon.plans.registry import query, rounded, table


def _by_status(spark, folder, status, *columns):
    return table(spark, folder, "orders").filter(F.col("o_orderstatus") == status).select(*columns)


@query("union_sources", """
SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT o_orderkey, o_totalprice, NULL FROM orders WHERE o_orderstatus = 'O'
UNION ALL SELECT o_orderkey, NULL, o_orderpriority FROM orders WHERE o_orderstatus = 'P'""")
def union_sources(spark, folder):
    return federation.union_sources(
        [
            _by_status(spark, folder, "F", "o_orderkey", "o_totalprice", "o_orderpriority"),
            _by_status(spark, folder, "O", "o_totalprice", "o_custkey", "o_orderkey"),
            _by_status(spark, folder, "P", "o_orderpriority", "o_orderkey"),
        ]
    )


JOINED = """
WITH a AS (SELECT CASE WHEN c_custkey % 97 = 0 THEN NULL ELSE c_custkey END AS k, c_custkey, c_mktsegment FROM customer),
b AS (SELECT CASE WHEN o_custkey % 97 = 0 THEN NULL ELSE o_custkey END AS k, o_orderkey, o_totalprice FROM orders),
c AS (SELECT user_id AS k, event_id, value FROM events),
a1 AS (SELECT k, max(c_custkey) AS c_custkey, arg_max(c_mktsegment, c_custkey) AS c_mktsegment FROM a GROUP BY k),
ab AS (SELECT a1.k, c_custkey, c_mktsegment, o_orderkey, o_totalprice FROM a1 JOIN b ON a1.k IS NOT DISTINCT FROM b.k),
ab1 AS (SELECT k, arg_max(c_custkey, o_orderkey) AS c_custkey, arg_max(c_mktsegment, o_orderkey) AS c_mktsegment,
  max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM ab GROUP BY k)
"""


def _sources(spark, folder):
    key = lambda column: F.when(F.col(column) % 97 != 0, F.col(column)).alias("k")
    return (
        table(spark, folder, "customer").select(key("c_custkey"), "c_custkey", "c_mktsegment"),
        table(spark, folder, "orders").select(key("o_custkey"), "o_orderkey", "o_totalprice"),
        table(spark, folder, "events").select(F.col("user_id").alias("k"), "event_id", "value"),
    )


@query("join_two_sources", JOINED + "SELECT * FROM ab")
def join_two_sources(spark, folder):
    customers, orders, _ = _sources(spark, folder)
    return federation.join_sources([customers, orders], ["k"], ["c_custkey", "o_orderkey"])


@query("join_three_sources", JOINED + """
SELECT ab1.k, c_custkey, c_mktsegment, o_orderkey, o_totalprice, event_id, value FROM ab1 JOIN c ON ab1.k IS NOT DISTINCT FROM c.k""")
def join_three_sources(spark, folder):
    return federation.join_sources(list(_sources(spark, folder)), ["k"], ["c_custkey", "o_orderkey", "event_id"])


@query("merge_sources", """
SELECT o_orderpriority, round(sum(o_totalprice), 4) AS o_totalprice, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL""")
def merge_sources(spark, folder):
    parts = [_by_status(spark, folder, s, "o_orderpriority", "o_totalprice", "o_orderkey") for s in ("F", "O", "P")]
    merged = federation.merge_sources(parts, ["o_orderpriority"], {"o_totalprice": "sum", "o_orderkey": "max"})
    return rounded(merged, 4, "o_totalprice")


@query("federate_with_failure", """
SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'O')""")
def federate_with_failure(spark, folder):
    def broken():
        raise ValueError("source is down")

    def fails_later():
        """A source whose rows raise an error only when they are read."""
        rows = _by_status(spark, folder, "P", "o_orderkey", "o_totalprice")
        return rows.withColumn("o_totalprice", F.when(F.col("o_totalprice") >= 0, F.raise_error(F.lit("bad row")).cast("double")))

    result = federation.federate(
        {
            "late": fails_later,
            "finished": lambda: _by_status(spark, folder, "F", "o_orderkey", "o_totalprice"),
            "broken": broken,
            "open": lambda: _by_status(spark, folder, "O", "o_orderkey", "o_totalprice"),
        },
        strategy="nonsense",
    )
    return result.combined


# -- point in time ------------------------------------------------------------------------------

VALUES = """
WITH v AS (SELECT CAST(user_id AS VARCHAR) AS entity_id, event_type AS feature_name, CAST(value AS VARCHAR) AS value, ts, event_id,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE ts + INTERVAL 7 DAY END AS valid_until FROM events),
e AS (SELECT CAST(c_custkey AS VARCHAR) AS entity_id FROM customer)
"""
NAMES = ["click", "purchase", "view"]
AS_OF = "2024-01-15 12:00:00"


def feature_values(spark, folder):
    """Stored feature values made from the events: the type is the feature, the user the entity."""
    return table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("entity_id"),
        F.col("event_type").alias("feature_name"),
        F.col("value").cast("string").alias("value"),
        F.col("value").cast("string").alias("feature_value"),
        F.col("ts").alias("timestamp"),
        F.col("ts").alias("created_at"),
        F.col("ts").alias("valid_from"),
        F.when(F.col("event_id") % 5 != 0, F.expr("ts + INTERVAL 7 DAYS")).alias("valid_until"),
    )


def entities(spark, folder):
    return table(spark, folder, "customer").select(F.col("c_custkey").cast("string").alias("entity_id"))


@query("features_valid_at", VALUES + f"""
, live AS (SELECT * FROM v WHERE ts <= TIMESTAMP '{AS_OF}' AND (valid_until IS NULL OR valid_until > TIMESTAMP '{AS_OF}'))
SELECT e.entity_id, arg_max(value, ts) FILTER (feature_name = 'click') AS click,
  arg_max(value, ts) FILTER (feature_name = 'purchase') AS purchase, arg_max(value, ts) FILTER (feature_name = 'view') AS view
FROM e LEFT JOIN live USING (entity_id) GROUP BY e.entity_id""")
def features_valid_at(spark, folder):
    return features.read_valid_at(feature_values(spark, folder), NAMES, entities(spark, folder), AS_OF)


@query("features_latest_at", VALUES + f"""
SELECT feature_name, entity_id, arg_max(value, ts) AS value, max(ts) AS timestamp FROM v
WHERE ts <= TIMESTAMP '{AS_OF}' AND feature_name IN ('click', 'purchase', 'view') GROUP BY ALL""")
def features_latest_at(spark, folder):
    return features.read_latest(feature_values(spark, folder), NAMES, AS_OF)


@query("features_served", VALUES + f"""
, live AS (SELECT * FROM v WHERE ts <= TIMESTAMP '{AS_OF}')
SELECT e.entity_id, coalesce(arg_max(value, ts) FILTER (feature_name = 'click'), '0.0') AS click,
  coalesce(arg_max(value, ts) FILTER (feature_name = 'purchase'), '1.5') AS purchase, arg_max(value, ts) FILTER (feature_name = 'view') AS view
FROM e LEFT JOIN live USING (entity_id) GROUP BY e.entity_id""")
def features_served(spark, folder):
    values, wanted = feature_values(spark, folder), entities(spark, folder)
    return features.serve(values, NAMES, wanted, {"click": 0.0, "purchase": 1.5}, AS_OF)


@query("events_enriched", """
WITH s AS (SELECT c_custkey AS user_id, c_mktsegment AS segment, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal END AS value FROM customer)
SELECT user_id, event_id, event_type, coalesce(s.value, e.value) AS value, segment FROM events e LEFT JOIN s USING (user_id)""")
def events_enriched(spark, folder):
    stored = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("user_id"),
        F.col("c_mktsegment").alias("segment"),
        F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal")).alias("value"),
    )
    events = table(spark, folder, "events").select("user_id", "event_id", "event_type", "value")
    return features.enrich_events(events, stored, "user_id")
