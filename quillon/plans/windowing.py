"""Windows over the events, in batch form, and event checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from quillon.operators import events as event_ops
from quillon.operators.windows import Agg, Everything, Session, Sliding, Tumbling, window_aggregate, window_definitions
from quillon.plans.registry import query, rounded, table
from quillon.session import stored
from quillon.streaming import topics

HOUR = 3_600_000
DAY = 24 * HOUR


@query("tumbling_counts", """
SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end,
  count(*) AS count FROM events GROUP BY ALL""")
def tumbling_counts(spark, folder):
    return window_aggregate(table(spark, folder, "events"), "event_type", Tumbling(HOUR), [Agg("count")])


@query("tumbling_aggregates", """
WITH w AS (SELECT *, time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS s FROM events)
SELECT event_type, s AS window_start, s + INTERVAL 1 DAY AS window_end, count(*) AS count, round(sum(value), 4) AS sum_value,
  round(avg(value), 9) AS avg_value, min(value) AS min_value, max(value) AS max_value, count(DISTINCT user_id) AS distinct_count_user_id,
  arg_min(value, (ts, event_id)) AS first_value, arg_max(value, (ts, event_id)) AS last_value FROM w GROUP BY ALL""")
def tumbling_aggregates(spark, folder):
    aggs = [Agg("count")] + [Agg(kind, "value") for kind in ("sum", "avg", "min", "max", "first", "last")]
    aggs.append(Agg("distinct_count", "user_id"))
    made = window_aggregate(table(spark, folder, "events"), "event_type", Tumbling(DAY), aggs)
    return rounded(rounded(made, 4, "sum_value"), 9, "avg_value")


@query("tumbling_percentiles", """
WITH r AS (SELECT event_type, time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS s, value,
    row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY event_type, time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01')) AS n
  FROM events WINDOW w AS (PARTITION BY event_type, time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') ORDER BY value))
SELECT event_type, s AS window_start, s + INTERVAL 1 DAY AS window_end, max(value) FILTER (i = least(floor(n * 50.0::DOUBLE / 100), n - 1)) AS p50,
  max(value) FILTER (i = least(floor(n * 95.0::DOUBLE / 100), n - 1)) AS p95 FROM r GROUP BY ALL""")
def tumbling_percentiles(spark, folder):
    aggs = [Agg("percentile", "value", 50, "p50"), Agg("percentile", "value", 95, "p95")]
    return window_aggregate(table(spark, folder, "events"), "event_type", Tumbling(DAY), aggs)


SLIDES = """
WITH x AS (SELECT *, time_bucket(INTERVAL {slide}, ts, TIMESTAMP '1970-01-01') AS last_start FROM events),
w AS (SELECT *, last_start - k * INTERVAL {slide} AS s FROM x, range(0, {many}) t(k))
"""


@query("sliding_default_slide", SLIDES.format(slide="3 HOUR", many=2) + """
SELECT event_type, s AS window_start, s + INTERVAL 6 HOUR AS window_end, count(*) AS count, round(sum(value), 4) AS sum_value FROM w GROUP BY ALL""")
def sliding_default_slide(spark, folder):
    made = window_aggregate(table(spark, folder, "events"), "event_type", Sliding(6 * HOUR), [Agg("count"), Agg("sum", "value")])
    return rounded(made, 4, "sum_value")


@query("sliding_aggregates", SLIDES.format(slide="8 HOUR", many=3) + """
SELECT user_id, s AS window_start, s + INTERVAL 24 HOUR AS window_end, round(avg(value), 9) AS avg_value, max(value) AS max_value,
  count(DISTINCT event_type) AS distinct_count_event_type, arg_max(event_type, (ts, event_id)) AS last_event_type FROM w GROUP BY ALL""")
def sliding_aggregates(spark, folder):
    aggs = [Agg("avg", "value"), Agg("max", "value"), Agg("distinct_count", "event_type"), Agg("last", "event_type")]
    return rounded(window_aggregate(table(spark, folder, "events"), "user_id", Sliding(DAY, 8 * HOUR), aggs), 9, "avg_value")


@query("sliding_wide", SLIDES.format(slide="15 MINUTE", many=1000) + """
SELECT event_type, s AS window_start, s + INTERVAL 250 HOUR AS window_end, count(*) AS count, round(sum(value), 4) AS sum_value, min(value) AS min_value,
  arg_min(user_id, (ts, event_id)) AS first_user_id FROM w GROUP BY ALL""")
def sliding_wide(spark, folder):
    """A thousand overlapping windows: blocks of slices, each read twice."""
    aggs = [Agg("count"), Agg("sum", "value"), Agg("min", "value"), Agg("first", "user_id")]
    made = window_aggregate(table(spark, folder, "events"), "event_type", Sliding(250 * HOUR, HOUR // 4), aggs)
    return rounded(made, 4, "sum_value")


@query("sliding_distinct", SLIDES.format(slide="1 HOUR", many=48) + """
SELECT event_type, s AS window_start, s + INTERVAL 48 HOUR AS window_end, count(DISTINCT user_id) AS distinct_count_user_id FROM w GROUP BY ALL""")
def sliding_distinct(spark, folder):
    return window_aggregate(table(spark, folder, "events"), "event_type", Sliding(2 * DAY, HOUR), [Agg("distinct_count", "user_id")])


@query("sliding_percentiles", SLIDES.format(slide="3 HOUR", many=16) + """
, r AS (SELECT event_type, s, value, row_number() OVER p - 1 AS i, count(*) OVER (PARTITION BY event_type, s) AS n FROM w WINDOW p AS (PARTITION BY event_type, s ORDER BY value))
SELECT event_type, s AS window_start, s + INTERVAL 48 HOUR AS window_end, max(value) FILTER (i = least(floor(n * 50.0::DOUBLE / 100), n - 1)) AS p50,
  max(value) FILTER (i = least(floor(n * 99.0::DOUBLE / 100), n - 1)) AS p99 FROM r GROUP BY ALL""")
def sliding_percentiles(spark, folder):
    aggs = [Agg("percentile", "value", 50, "p50"), Agg("percentile", "value", 99, "p99")]
    return window_aggregate(table(spark, folder, "events"), "event_type", Sliding(2 * DAY, 3 * HOUR), aggs)


SESSIONS = """
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL {gap} THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY {key} ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY {key} ORDER BY ts) AS session FROM g)
"""


@query("session_windows", SESSIONS.format(gap="6 HOUR", key="user_id") + """
SELECT user_id, min(ts) AS window_start, max(ts) + INTERVAL 6 HOUR AS window_end, count(*) AS count, round(sum(value), 4) AS sum_value,
  arg_min(event_type, (ts, event_id)) AS first_event_type FROM s GROUP BY user_id, session""")
def session_windows(spark, folder):
    aggs = [Agg("count"), Agg("sum", "value"), Agg("first", "event_type")]
    return rounded(window_aggregate(table(spark, folder, "events"), "user_id", Session(6 * HOUR), aggs), 4, "sum_value")


@query("session_default_gap", SESSIONS.format(gap="5 MINUTE", key="event_type") + """
SELECT event_type, min(ts) AS window_start, max(ts) + INTERVAL 5 MINUTE AS window_end, count(*) AS count,
  count(DISTINCT user_id) AS distinct_count_user_id FROM s GROUP BY event_type, session""")
def session_default_gap(spark, folder):
    return window_aggregate(table(spark, folder, "events"), "event_type", Session(), [Agg("count"), Agg("distinct_count", "user_id")])


@query("session_one_key", """
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 1 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (ORDER BY ts) AS session FROM g)
SELECT 'all' AS everyone, min(ts) AS window_start, max(ts) + INTERVAL 1 MINUTE AS window_end, count(*) AS count, round(sum(value), 4) AS sum_value FROM s GROUP BY session""")
def session_one_key(spark, folder):
    """All events under one key: ranges of time are put in order side by side."""
    events = table(spark, folder, "events").withColumn("everyone", F.lit("all"))
    return rounded(window_aggregate(events, "everyone", Session(60_000), [Agg("count"), Agg("sum", "value")]), 4, "sum_value")


@query("global_window", """
WITH r AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY value))
SELECT user_id, count(*) AS count, round(avg(value), 9) AS avg_value, max(value) FILTER (i = least(floor(n * 90.0::DOUBLE / 100), n - 1)) AS p90 FROM r GROUP BY user_id""")
def global_window(spark, folder):
    aggs = [Agg("count"), Agg("avg", "value"), Agg("percentile", "value", 90, "p90")]
    return rounded(window_aggregate(table(spark, folder, "events"), "user_id", Everything(), aggs), 9, "avg_value")


@query("payload_numbers", """
WITH w AS (SELECT *, time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS s, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)
SELECT event_type, s AS window_start, s + INTERVAL 1 DAY AS window_end, sum(k) AS sum_props_k, max(k) AS max_props_k FROM w GROUP BY ALL""")
def payload_numbers(spark, folder):
    return window_aggregate(table(spark, folder, "events"), "event_type", Tumbling(DAY), [Agg("sum", "props.k"), Agg("max", "props.k")])


@query("many_definitions", """
SELECT 'by_type' AS definition, event_type AS key, time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS window_start, count(*) AS count FROM events GROUP BY ALL
UNION ALL SELECT 'by_user', CAST(user_id AS VARCHAR), time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01'), count(*) FROM events GROUP BY ALL""")
def many_definitions(spark, folder):
    events = table(spark, folder, "events").withColumn("user", F.col("user_id").cast("string"))
    made = window_definitions(
        events,
        {"by_type": ("event_type", Tumbling(DAY), [Agg("count")]), "by_user": ("user", Tumbling(7 * DAY), [Agg("count")])},
    )
    rows = [df.select(F.lit(name).alias("definition"), F.col(df.columns[0]).alias("key"), "window_start", "count") for name, df in made.items()]
    return rows[0].unionAll(rows[1])


# -- event records ------------------------------------------------------------------------------

def event_json(spark, folder):
    """Events as JSON records, with flaws at fixed remainders of the id."""
    flaw = lambda n: F.col("event_id") % n == 0
    payload = F.when(flaw(13), F.struct(F.lit(None).cast("string").alias("page"), F.lit(None).cast("string").alias("element"))).otherwise(
        F.struct(F.concat(F.lit("p"), F.col("user_id")).alias("page"), F.when(~flaw(5), F.lit("button")).alias("element"))
    )
    kind = F.when(F.col("event_type").isin("click", "view"), "user_action").when(
        F.col("event_type") == "error", "system_event"
    ).otherwise("business_event")
    record = F.struct(
        F.col("event_id").cast("string").alias("event_id"),
        F.when(flaw(17), F.lit("mystery")).otherwise(kind).alias("event_type"),
        F.col("event_type").alias("event_name"),
        F.when(~flaw(7), F.lit("web")).alias("source_service"),
        F.when(flaw(11), F.lit("yesterday")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).alias("timestamp"),
        F.col("user_id").cast("string").alias("user_id"),
        F.lit("s1").alias("session_id"),
        F.lit("tap").alias("action"),
        F.lit("api").alias("component"),
        F.when(flaw(3), F.lit("fatal")).otherwise(F.lit("warning")).alias("severity"),
        F.lit("model").alias("model_name"),
        F.lit("1").alias("model_version"),
        (F.col("value") / 100).alias("confidence_score"),
        F.lit("latency").alias("metric_name"),
        F.col("value").alias("metric_value"),
        F.when(flaw(3), F.lit("Gauge")).otherwise(F.lit("meter")).alias("metric_type"),
        payload.alias("payload"),
    )
    text = F.when(flaw(19), F.lit("{broken")).otherwise(F.to_json(record))
    return table(spark, folder, "events").select("event_id", text.alias("value")).withColumnRenamed("event_id", "source_id")


FLAWS = """
WITH e AS (SELECT event_id, event_type, value, ts, event_id % 19 = 0 AS broken, event_id % 7 = 0 AS no_service, event_id % 17 = 0 AS mystery,
  event_id % 11 = 0 AS bad_time, event_id % 13 = 0 AS no_payload, event_id % 5 = 0 AS no_element, event_id % 3 = 0 AS third FROM events),
f AS (SELECT *, unnest([x FOR x IN [CASE WHEN broken THEN 'not json' END, CASE WHEN NOT broken AND no_service THEN 'missing source_service' END,
  CASE WHEN NOT broken AND mystery THEN 'unknown event_type' END, CASE WHEN NOT broken AND bad_time THEN 'bad timestamp' END,
  CASE WHEN NOT broken AND no_payload THEN 'empty payload' END {more}] IF x IS NOT NULL]) AS error FROM e)
"""


def _error_counts(checked):
    return checked.select(F.explode("errors").alias("error")).groupBy("error").agg(F.count(F.lit(1)).alias("events"))


@query("event_base_errors", FLAWS.format(more="") + "SELECT error, count(*) AS events FROM f GROUP BY ALL")
def event_base_errors(spark, folder):
    return _error_counts(event_ops.check_events(event_json(spark, folder)))


@query("event_user_action_errors", FLAWS.format(more=", CASE WHEN NOT broken AND NOT no_payload AND no_element THEN 'payload without element' END") + "SELECT error, count(*) AS events FROM f GROUP BY ALL")
def event_user_action_errors(spark, folder):
    return _error_counts(event_ops.check_events(event_json(spark, folder), schema_name="user_action"))


@query("event_system_errors", FLAWS.format(more=", CASE WHEN NOT broken AND third THEN 'unknown severity' END") + "SELECT error, count(*) AS events FROM f GROUP BY ALL")
def event_system_errors(spark, folder):
    return _error_counts(event_ops.check_events(event_json(spark, folder), schema_name="system_event"))


@query("event_prediction_errors", FLAWS.format(more=", CASE WHEN NOT broken AND value / 100 > 1 THEN 'confidence out of range' END") + "SELECT error, count(*) AS events FROM f GROUP BY ALL")
def event_prediction_errors(spark, folder):
    return _error_counts(event_ops.check_events(event_json(spark, folder), schema_name="ml_prediction"))


@query("event_metric_errors", FLAWS.format(more=", CASE WHEN NOT broken AND NOT third THEN 'unknown metric_type' END") + "SELECT error, count(*) AS events FROM f GROUP BY ALL")
def event_metric_errors(spark, folder):
    return _error_counts(event_ops.check_events(event_json(spark, folder), schema_name="metric_event"))


@query("event_split_valid", FLAWS.format(more="") + """
SELECT event_id AS source_id, CASE WHEN event_type IN ('click', 'view') THEN 'user_action' WHEN event_type = 'error' THEN 'system_event' ELSE 'business_event' END AS event_type,
  ts AS event_time FROM e WHERE NOT (broken OR no_service OR mystery OR bad_time OR no_payload)""")
def event_split_valid(spark, folder):
    valid, _ = event_ops.split_events(event_ops.check_events(event_json(spark, folder)))
    return valid.select("source_id", "event_type", F.col("event_time").cast("timestamp_ntz").alias("event_time"))


@query("event_routes", FLAWS.format(more="") + """
SELECT CASE WHEN event_type IN ('click', 'view') THEN 'user_action' WHEN event_type = 'error' THEN 'system_event' ELSE 'business_event' END AS route,
  count(*) AS events FROM e WHERE NOT (broken OR no_service OR mystery OR bad_time OR no_payload) GROUP BY ALL""")
def event_routes(spark, folder):
    """The checked events are written once, so that no route decodes them again."""
    checked = stored(event_ops.check_events(event_json(spark, folder)).select("event_type", "is_valid"), "routes")
    valid, _ = event_ops.split_events(checked)
    routes = event_ops.route_events(valid)
    kept = [df.select(F.lit(name).alias("route")) for name, df in routes.items()]
    return reduce(DataFrame.unionAll, kept).groupBy("route").agg(F.count(F.lit(1)).alias("events"))


# -- topics -------------------------------------------------------------------------------------


@query("event_topic_records", """
SELECT CAST(user_id AS VARCHAR) AS key, event_type, CAST(epoch_us(ts) // 1000000 AS VARCHAR) AS timestamp, 6 AS headers, CAST(event_id AS VARCHAR) AS event_id, ts FROM events""")
def event_topic_records(spark, folder):
    events = table(spark, folder, "events").select(
        F.col("event_id").cast("string").alias("event_id"), F.col("user_id").cast("string").alias("user_id"), "event_type",
        F.col("event_type").alias("event_name"), F.lit("web").alias("source_service"), F.lit("1.0").alias("schema_version"), "ts", "value",
    )
    records = topics.topic_records(events, key="user_id", time="ts")
    header = F.map_from_entries("headers")
    return records.select(
        "key",
        header["event_type"].cast("string").alias("event_type"),
        header["timestamp"].cast("string").alias("timestamp"),
        F.size("headers").alias("headers"),
        F.get_json_object("value", "$.event_id").alias("event_id"),
        F.get_json_object("value", "$.ts").cast("timestamp_ntz").alias("ts"),
    )


@query("event_dead_letters", FLAWS.format(more="") + """
, m AS (SELECT event_id, string_agg(error, '; ' ORDER BY list_position(['not json', 'missing source_service', 'unknown event_type', 'bad timestamp', 'empty payload'], error)) AS error_message FROM f GROUP BY event_id)
SELECT 'events.dlq' AS topic, CAST(event_id AS VARCHAR) AS original_offset, error_message FROM m""")
def event_dead_letters(spark, folder):
    records = event_json(spark, folder).withColumnRenamed("source_id", "offset").withColumn("topic", F.lit("events"))
    _, bad = event_ops.split_events(event_ops.check_events(records))
    letters = topics.dead_letters(bad)
    return letters.select(
        "topic",
        F.get_json_object("value", "$.original_offset").alias("original_offset"),
        F.get_json_object("value", "$.error_message").alias("error_message"),
    )
