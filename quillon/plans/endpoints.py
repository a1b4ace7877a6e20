"""Files, reports, ingestion and streams over the given tables, and searches of the run log."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from quillon.operators import drift, experiments, runlog
from quillon.operators.ingestion import ingest
from quillon.operators.windows import Agg, Session, Sliding, Tumbling
from quillon.plans.operations import END, RUNS, runs
from quillon.plans.registry import query, rounded, table
from quillon.session import checkpoint_folder
from quillon.sources.files import read_file, write_file, write_report
from quillon.streaming.alerts import STATE_STORE
from quillon.streaming.features import feature_writer
from quillon.streaming.windows import window_writers

STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def work_folder(spark) -> str:
    return f"{checkpoint_folder(spark)}/endpoints-{uuid.uuid4().hex}"


@query("source_file", "SELECT * FROM events")
def source_file(spark, folder):
    return read_file(spark, f"{folder}/events.parquet")


@query("file_round_trip", "SELECT 'csv' AS kind, * FROM events UNION ALL SELECT 'json', * FROM events UNION ALL SELECT 'parquet', * FROM events")
def file_round_trip(spark, folder):
    """All events through each file format and back, to the microsecond."""
    work, parts = work_folder(spark), []
    for kind in ("csv", "json", "parquet"):
        write_file(table(spark, folder, "events"), f"{work}/events.{kind}")
        parts.append(read_file(spark, f"{work}/events.{kind}", EVENT_SCHEMA).select(F.lit(kind).alias("kind"), "*"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("report_files", """
SELECT 'by_type' AS report, event_type AS key, count(*) AS events, max(ts) AS last FROM events GROUP BY ALL
UNION ALL SELECT 'by_user', CAST(user_id AS VARCHAR), count(*), max(ts) FROM events GROUP BY user_id""")
def report_files(spark, folder):
    events, work = table(spark, folder, "events"), work_folder(spark)
    count = lambda key: events.groupBy(F.col(key).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("events"), F.max("ts").alias("last"))
    write_report({"by_type": count("event_type"), "by_user": count("user_id")}, work, "json")
    read = lambda name: read_file(spark, f"{work}/{name}.json", "key string, events long, last timestamp_ntz")
    return read("by_type").select(F.lit("by_type").alias("report"), "*").unionByName(read("by_user").select(F.lit("by_user").alias("report"), "*"))


@query("ingestion_run", """
WITH d AS (SELECT count(*) AS n FROM orders)
SELECT 'success' AS status, n AS rows, n AS row_count, 6 AS column_count, 0::BIGINT AS missing_cells, 0::BIGINT AS duplicate_rows FROM d""")
def ingestion_run(spark, folder):
    done = ingest(spark, f"{folder}/orders.parquet", f"{work_folder(spark)}/orders.parquet", "orders")
    return done.profile.select(F.lit(done.status).alias("status"), F.lit(done.rows).cast("long").alias("rows"), "row_count", "column_count", "missing_cells", "duplicate_rows")


def event_stream(spark, folder) -> DataFrame:
    return spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", "events.parquet").parquet(folder)


def drained(writer) -> None:
    running = writer.trigger(availableNow=True).start()
    running.awaitTermination()


@query("feature_stream_rows", """
SELECT CAST(user_id AS VARCHAR) AS entity_id, feature_name, value, count(*) AS n FROM (
  SELECT user_id, 'doubled' AS feature_name, round(value * 2, 6) AS value FROM events UNION ALL SELECT user_id, 'own', round(value, 6) FROM events) GROUP BY ALL""")
def feature_stream_rows(spark, folder):
    """What a stream over the events hands to the feature writer."""
    work = work_folder(spark)
    rows = event_stream(spark, folder).withColumn("entity_id", F.col("user_id").cast("string"))
    drained(feature_writer(rows, {"doubled": "$value * 2", "own": "$value"}, lambda df, n: df.write.mode("overwrite").parquet(f"{work}/rows/batch={n}"), f"{work}/progress"))
    found = spark.read.parquet(f"{work}/rows")
    return found.groupBy("entity_id", "feature_name", F.round(F.col("value").cast("double"), 6).alias("value")).agg(F.count(F.lit(1)).alias("n"))


@query("stream_closed_windows", """
WITH w AS (SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, ts, value FROM events), m AS (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM events)
SELECT event_type, window_start, window_start + INTERVAL 1 HOUR AS window_end, count(*) AS count, round(sum(value), 4) AS sum_value FROM w, m WHERE window_start + INTERVAL 1 HOUR <= mark GROUP BY ALL""")
def stream_closed_windows(spark, folder):
    """The hourly windows that a stream with a day's lateness has closed after all events."""
    work = work_folder(spark)
    stream = event_stream(spark, folder).withColumn("ts", F.col("ts").cast("timestamp"))
    writers = window_writers(
        stream, {"hourly": ("event_type", Tumbling(3_600_000), [Agg("count"), Agg("sum", "value")])},
        lambda name, df, n: df.write.mode("overwrite").parquet(f"{work}/{name}/batch={n}"), f"{work}/progress", lateness="1 day",
    )
    drained(writers["hourly"])
    found = spark.read.parquet(f"{work}/hourly").drop("batch")
    ends = {c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")}
    return rounded(found.withColumns(ends), 4, "sum_value")


EXACT = """
WITH x AS (SELECT *, time_bucket(INTERVAL {slide}, ts, TIMESTAMP '1970-01-01') AS last_start FROM events),
w AS (SELECT *, last_start - k * INTERVAL {slide} AS s FROM x, range(0, {many}) t(k)), m AS (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM events),
r AS (SELECT *, row_number() OVER p - 1 AS i, count(*) OVER (PARTITION BY event_type, s) AS n FROM w, m WHERE s + INTERVAL {size} <= mark WINDOW p AS (PARTITION BY event_type, s ORDER BY value))
SELECT event_type, s AS window_start, s + INTERVAL {size} AS window_end, count(*) AS count, count(DISTINCT user_id) AS distinct_count_user_id,
  max(value) FILTER (i = least(floor(n * 90.0::DOUBLE / 100), n - 1)) AS p90, arg_max(props, (ts, event_id)) AS last_props FROM r GROUP BY ALL"""


EXACTLY = [Agg("count"), Agg("distinct_count", "user_id"), Agg("percentile", "value", 90, "p90"), Agg("last", "props")]


def closed_exactly(spark, folder, key, window, aggs) -> DataFrame:
    """What a stream with a day's lateness has closed of a window after all events, with exact aggregations."""
    work = work_folder(spark)
    held = spark.conf.get(STATE_PROVIDER, None)
    spark.conf.set(STATE_PROVIDER, STATE_STORE)
    try:
        writers = window_writers(
            event_stream(spark, folder), {"exact": (key, window, aggs)},
            lambda name, df, n: df.write.mode("overwrite").parquet(f"{work}/{name}/batch={n}"), f"{work}/progress", lateness="1 day",
        )
        drained(writers["exact"])
    finally:
        spark.conf.set(STATE_PROVIDER, held) if held else spark.conf.unset(STATE_PROVIDER)
    found = spark.read.parquet(f"{work}/exact").drop("batch")
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


@query("stream_exact_windows", EXACT.format(slide="7 DAY", many=1, size="7 DAY"))
def stream_exact_windows(spark, folder):
    return closed_exactly(spark, folder, "event_type", Tumbling(7 * 86_400_000), EXACTLY)


@query("stream_exact_sliding", EXACT.format(slide="3 DAY", many=2, size="6 DAY"))
def stream_exact_sliding(spark, folder):
    return closed_exactly(spark, folder, "event_type", Sliding(6 * 86_400_000, 3 * 86_400_000), EXACTLY)


@query("stream_exact_sessions", """
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g)
SELECT user_id, min(ts) AS window_start, max(ts) + INTERVAL 12 HOUR AS window_end, count(*) AS count, count(DISTINCT event_type) AS distinct_count_event_type FROM s
GROUP BY user_id, session HAVING max(ts) + INTERVAL 12 HOUR < (SELECT max(ts) - INTERVAL 1 DAY FROM events)""")
def stream_exact_sessions(spark, folder):
    return closed_exactly(spark, folder, "user_id", Session(12 * 3_600_000), [Agg("count"), Agg("distinct_count", "event_type")])


@query("run_search", RUNS + "SELECT run_id, workflow_name, status FROM runs WHERE status = 'failed' AND workflow_name = 'flow-2'")
def run_search(spark, folder):
    found = runlog.search_runs(runs(spark, folder), "status = 'failed' AND workflow_name = 'flow-2'", ["start_time desc", "run_id"])
    return found.select("run_id", "workflow_name", "status")


@query("run_overview", RUNS + f"""
SELECT count(DISTINCT workflow_name) AS workflows, count(*) AS executions, count(*) FILTER (start_time >= TIMESTAMP '{END}' - INTERVAL 24 HOUR) AS executions_24h,
  round(count(*) FILTER (status = 'success') * 100.0 / count(*), 6) AS success_rate,
  round(count(*) FILTER (status = 'success' AND start_time >= TIMESTAMP '{END}' - INTERVAL 24 HOUR) * 100.0 / count(*) FILTER (start_time >= TIMESTAMP '{END}' - INTERVAL 24 HOUR), 6) AS success_rate_24h FROM runs""")
def run_overview(spark, folder):
    return rounded(runlog.overview(runs(spark, folder), END), 6, "success_rate", "success_rate_24h")


def run_steps(spark, folder):
    """A metric value per event: the run is the user, the step the day."""
    return table(spark, folder, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("key"), F.dayofmonth("ts").alias("step"), "value")


@query("newest_metrics", """
SELECT user_id AS run_id, event_type AS key, arg_max(value, (day(ts), value)) AS value, max(day(ts))::INTEGER AS step FROM events GROUP BY ALL""")
def newest_metrics(spark, folder):
    return experiments.newest_metrics(run_steps(spark, folder))


@query("metric_history", "SELECT user_id AS run_id, event_type AS key, day(ts)::INTEGER AS step, value FROM events WHERE user_id = 3 AND event_type = 'view'")
def metric_history(spark, folder):
    return experiments.metric_history(run_steps(spark, folder), 3, "view")


FINISHED = """c AS (SELECT CASE WHEN o_orderstatus = 'F' OR o_orderpriority = '5-LOW' THEN o_orderpriority ELSE 'to ' || o_orderpriority END AS v, o_orderstatus = 'F' AS base FROM orders),
s AS (SELECT v, count(*) FILTER (base) AS n_base, count(*) FILTER (NOT base) AS n_now FROM c GROUP BY v)"""


def finished_and_open(spark, folder):
    """Finished orders and the others, whose priorities but the lowest are renamed."""
    orders = table(spark, folder, "orders").withColumn("done", F.col("o_orderstatus") == "F")
    same = F.col("done") | (F.col("o_orderpriority") == "5-LOW")
    rows = orders.withColumn("priority", F.when(same, F.col("o_orderpriority")).otherwise(F.concat(F.lit("to "), "o_orderpriority")))
    return rows.filter("done"), rows.filter(~F.col("done"))


@query("feature_drift", """
WITH n AS (SELECT avg(o_totalprice) FILTER (o_orderstatus = 'F') AS a, avg(o_totalprice) FILTER (o_orderstatus <> 'F') AS b, stddev_samp(o_totalprice) FILTER (o_orderstatus = 'F') AS s, stddev_samp(o_totalprice) FILTER (o_orderstatus <> 'F') AS r FROM orders),
c AS (SELECT CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE 'to ' || o_orderpriority END AS v, o_orderstatus = 'F' AS base FROM orders)
SELECT 'o_totalprice' AS feature_name, 'numeric' AS kind, round(least((abs(b - a) + abs(r - s)) / (2 * s), 1.0), 6) AS drift_score, '' AS new_categories, '' AS missing_categories FROM n
UNION ALL SELECT 'priority', 'categorical', 1.0, (SELECT string_agg(DISTINCT v, ',' ORDER BY v) FROM c WHERE NOT base), (SELECT string_agg(DISTINCT v, ',' ORDER BY v) FROM c WHERE base)""")
def feature_drift(spark, folder):
    """Finished orders against the others, whose priorities are renamed, with the names of the changed categories."""
    orders = table(spark, folder, "orders").withColumn("done", F.col("o_orderstatus") == "F")
    rows = orders.withColumn("priority", F.when(F.col("done"), F.col("o_orderpriority")).otherwise(F.concat(F.lit("to "), "o_orderpriority")))
    sides = rows.filter("done"), rows.filter(~F.col("done"))
    made = drift.feature_drift(*sides, ["o_totalprice"], ["priority"]).drop("new_categories", "missing_categories")
    named = made.join(drift.changed_names(drift.category_changes(*sides, ["priority"])), "feature_name", "left")
    names = {c: F.coalesce(F.array_join(c, ","), F.lit("")) for c in ("new_categories", "missing_categories")}
    return rounded(named.withColumns(names), 6, "drift_score").select("feature_name", "kind", "drift_score", *names)


@query("feature_drift_categories", f"""
WITH {FINISHED}
SELECT 'priority' AS feature_name, v AS category, CASE WHEN n_base = 0 THEN 'new' ELSE 'missing' END AS change FROM s WHERE n_base = 0 OR n_now = 0""")
def feature_drift_categories(spark, folder):
    return drift.category_changes(*finished_and_open(spark, folder), ["priority"])
