"""Run-log queries: every event is a run of the workflow named after its user's group."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from quillon.operators import runlog
from quillon.operators.runlog import MetricRule, RunRule
from quillon.plans.registry import query, rounded, table

END = "2024-01-30 18:30:00"
MESSAGES = ["Connection refused by warehouse cluster", "Timeout waiting for upstream partition", "Invalid schema in feature table\nat line 3"]


def runs(spark, folder):
    i = F.col("event_id")
    message = F.element_at(F.array(*[F.lit(m) for m in MESSAGES]), (i % 3 + 1).cast("int"))
    status = F.when(F.col("event_type") == "error", "failed").when(i % 17 == 0, "cancelled").otherwise("success")
    return table(spark, folder, "events").select(
        i.alias("run_id"),
        F.concat(F.lit("flow-"), F.col("user_id") % 5).alias("workflow_name"),
        status.alias("status"),
        F.col("ts").alias("start_time"),
        F.when(i % 9 != 0, F.col("value") * 60).alias("duration_seconds"),
        (i % 6 + 1).alias("total_tasks"),
        (i % 6).alias("completed_tasks"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).cast("long").alias("failed_tasks"),
        F.when(F.col("event_type") == "error", message).alias("error_message"),
    )


RUNS = """
WITH runs AS (SELECT event_id AS run_id, 'flow-' || (user_id % 5) AS workflow_name, CASE WHEN event_type = 'error' THEN 'failed' WHEN event_id % 17 = 0 THEN 'cancelled' ELSE 'success' END AS status, ts AS start_time,
  CASE WHEN event_id % 9 <> 0 THEN value * 60 END AS duration_seconds, event_id % 6 + 1 AS total_tasks, event_id % 6 AS completed_tasks, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS failed_tasks,
  CASE WHEN event_type = 'error' THEN CASE event_id % 3 WHEN 0 THEN 'Connection refused by warehouse cluster' WHEN 1 THEN 'Timeout waiting for upstream partition' ELSE 'Invalid schema in feature table' END END AS error_message FROM events),
m AS (SELECT workflow_name, count(*) AS total_executions, count(*) FILTER (status = 'success') AS successful_executions, count(*) FILTER (status = 'failed') AS failed_executions, count(*) FILTER (status = 'cancelled') AS cancelled_executions,
  count(*) FILTER (status = 'success') * 100.0 / count(*) AS success_rate, avg(duration_seconds) AS avg_duration_seconds, min(duration_seconds) AS min_duration_seconds, max(duration_seconds) AS max_duration_seconds,
  sum(total_tasks)::BIGINT AS total_tasks_executed, sum(total_tasks) / count(*) AS avg_tasks_per_workflow, sum(completed_tasks) * 100.0 / (sum(completed_tasks) + sum(failed_tasks)) AS task_success_rate FROM runs GROUP BY ALL)
"""


@query("run_summary", RUNS + """
SELECT workflow_name, total_executions, successful_executions, failed_executions, cancelled_executions, round(success_rate, 6) AS success_rate, round(avg_duration_seconds, 6) AS avg_duration_seconds,
  round(min_duration_seconds, 6) AS min_duration_seconds, round(max_duration_seconds, 6) AS max_duration_seconds, total_tasks_executed, round(avg_tasks_per_workflow, 6) AS avg_tasks_per_workflow, round(task_success_rate, 6) AS task_success_rate FROM m""")
def run_summary(spark, folder):
    made = runlog.run_metrics(runs(spark, folder))
    return rounded(made, 6, *[c for c in made.columns if c.endswith(("rate", "seconds", "per_workflow"))])


@query("run_common_errors", RUNS + "SELECT error_message AS error, count(*) AS count FROM runs WHERE status = 'failed' GROUP BY ALL ORDER BY 2 DESC, 1 LIMIT 5")
def run_common_errors(spark, folder):
    return runlog.common_errors(runs(spark, folder))


@query("run_hourly_counts", RUNS + f"""
, h AS (SELECT 23 - floor((epoch_us(TIMESTAMP '{END}') - epoch_us(start_time)) / 3600000000) AS slot FROM runs WHERE start_time <= TIMESTAMP '{END}')
SELECT i::INTEGER AS hour_slot, count(slot) AS executions FROM range(0, 24) t(i) LEFT JOIN h ON slot = i GROUP BY i""")
def run_hourly_counts(spark, folder):
    return runlog.hourly_counts(runs(spark, folder), END)


@query("run_daily_success", RUNS + f"""
SELECT (DATE '{END[:10]}' - i::INTEGER)::DATE AS day, coalesce(round(count(*) FILTER (status = 'success') * 100.0 / nullif(count(status), 0), 6), 0) AS success_rate
FROM range(1, 8) t(i) LEFT JOIN runs ON start_time::DATE = DATE '{END[:10]}' - i::INTEGER GROUP BY i""")
def run_daily_success(spark, folder):
    return rounded(runlog.daily_success(runs(spark, folder), END), 6, "success_rate")


@query("run_health", RUNS + """
, h AS (SELECT workflow_name, 100.0 - greatest(95 - success_rate, 0) * 0.4 - greatest(failed_executions * 100.0 / total_executions - 5, 0) * 0.2 - least(20, greatest((avg_duration_seconds - 3600) / 3600 * 20, 0)) - greatest(95 - task_success_rate, 0) * 0.1 AS s FROM m)
SELECT workflow_name, round(s, 6) AS health_score, CASE WHEN s >= 90 THEN 'healthy' WHEN s >= 70 THEN 'degraded' ELSE 'unhealthy' END AS health_status FROM h""")
def run_health(spark, folder):
    made = runlog.with_health(runlog.run_metrics(runs(spark, folder)))
    return rounded(made.select("workflow_name", "health_score", "health_status"), 6, "health_score")


@query("run_recurring_failures", RUNS + """
SELECT workflow_name, CASE error_message WHEN 'Connection refused by warehouse cluster' THEN 'Connection refused warehouse' WHEN 'Timeout waiting for upstream partition' THEN 'Timeout waiting upstream' ELSE 'Invalid schema feature' END AS pattern,
  count(*) AS occurrences FROM runs WHERE status = 'failed' GROUP BY ALL HAVING count(*) >= 3""")
def run_recurring_failures(spark, folder):
    return runlog.recurring_failures(runs(spark, folder))


@query("run_performance_issues", RUNS + """
SELECT workflow_name, unnest([x FOR x IN [CASE WHEN avg_duration_seconds > 3600 THEN 'High average duration' END, CASE WHEN max_duration_seconds > avg_duration_seconds * 3 THEN 'High duration variability detected' END,
  CASE WHEN task_success_rate < 90 THEN 'Low task success rate' END] IF x IS NOT NULL]) AS issue FROM m""")
def run_performance_issues(spark, folder):
    return runlog.performance_issues(runlog.run_metrics(runs(spark, folder)))


@query("run_declining", RUNS + f"""
, d AS (SELECT i, coalesce(count(*) FILTER (status = 'success') * 100.0 / nullif(count(status), 0), 0) AS r FROM range(1, 4) t(i) LEFT JOIN runs ON start_time::DATE = DATE '{END[:10]}' - i::INTEGER GROUP BY i)
SELECT (SELECT r FROM d WHERE i = 3) > (SELECT r FROM d WHERE i = 2) AND (SELECT r FROM d WHERE i = 2) > (SELECT r FROM d WHERE i = 1) AS declining""")
def run_declining(spark, folder):
    return runlog.declining(runlog.daily_success(runs(spark, folder), END))


@query("run_alert_rule", RUNS + f"""
, p AS (SELECT * FROM runs WHERE start_time >= TIMESTAMP '{END}' - INTERVAL 600 MINUTE AND workflow_name = 'flow-1'),
l AS (SELECT status, row_number() OVER (ORDER BY start_time DESC, run_id DESC) AS i FROM p),
s AS (SELECT count(*) AS executions, count(*) FILTER (status = 'success') * 100.0 / count(*) AS sr, avg(duration_seconds) AS d, count(*) FILTER (status = 'failed') AS e,
  coalesce((SELECT min(i) FROM l WHERE status <> 'failed') - 1, (SELECT count(*) FROM l))::INTEGER AS k FROM p)
SELECT executions, round(sr, 6) AS success_rate, round(d, 6) AS avg_duration, e AS error_count, k AS failure_streak,
  array_to_string([x FOR x IN [CASE WHEN sr < 90 THEN 'success_rate' END, CASE WHEN d > 1000 THEN 'duration' END, CASE WHEN e > 1 THEN 'error_count' END, CASE WHEN k >= 1 THEN 'failure_streak' END] IF x IS NOT NULL], ',') AS triggered
FROM s WHERE executions > 0 AND (sr < 90 OR d > 1000 OR e > 1 OR k >= 1)""")
def run_alert_rule(spark, folder):
    rule = RunRule("busy", "high", "flow-1", 600, success_rate=90, duration_seconds=1000, error_count=1, failure_streak=1)
    made = runlog.run_alerts(runs(spark, folder), rule, dt.datetime(2024, 1, 30, 18, 30), "run_id")
    made = made.withColumn("triggered", F.array_join("triggered_conditions", ",")).drop("triggered_conditions", "rule_name", "severity")
    return rounded(made, 6, "success_rate", "avg_duration")


RULES = [
    MetricRule("high_click", "click", "greater_than", 60.0),
    MetricRule("low_click", "click", "less_than", 5.0),
    MetricRule("same_view", "view", "equals", 10.0),
    MetricRule("purchase_moves", "purchase", "not_equals", 10.0),
]


@query("metric_alert_transitions", """
WITH h AS (SELECT 'high_click' AS rule_name, event_id, ts, value, value > 60 AS holds FROM events WHERE event_type = 'click'
  UNION ALL SELECT 'low_click', event_id, ts, value, value < 5 FROM events WHERE event_type = 'click'
  UNION ALL SELECT 'same_view', event_id, ts, value, abs(value - 10) < 0.001 FROM events WHERE event_type = 'view'
  UNION ALL SELECT 'purchase_moves', event_id, ts, value, abs(value - 10) >= 0.001 FROM events WHERE event_type = 'purchase'),
l AS (SELECT *, coalesce(lag(holds) OVER (PARTITION BY rule_name ORDER BY ts, event_id), false) AS was FROM h)
SELECT rule_name, event_id, value, CASE WHEN holds AND NOT was THEN 'triggered' WHEN holds THEN 'updated' ELSE 'resolved' END AS transition FROM l WHERE holds OR was""")
def metric_alert_transitions(spark, folder):
    readings = table(spark, folder, "events").select("event_id", "ts", F.col("event_type").alias("metric_name"), "value")
    return runlog.metric_alerts(readings, RULES, "ts", "event_id").select("rule_name", "event_id", "value", "transition")


@query("latency_summary", """
WITH r AS (SELECT value, row_number() OVER (ORDER BY value) AS i, count(*) OVER () AS n FROM events),
j AS (SELECT DISTINCT n, least(greatest(1, (n + 1) * 19 // 20), n - 1) AS j, (n + 1) * 19 - 20 * least(greatest(1, (n + 1) * 19 // 20), n - 1) AS d FROM r)
SELECT (SELECT count(*) FROM events) AS total_events, (SELECT round(avg(value), 9) FROM events) AS avg_latency,
  round(((SELECT value FROM r WHERE i = j.j) * (20 - d) + (SELECT value FROM r WHERE i = j.j + 1) * d) / 20, 6) AS p95_latency, (SELECT value FROM r WHERE i = least(floor(0.99::DOUBLE * j.n), j.n - 1) + 1) AS p99_latency,
  (SELECT round(count(*) FILTER (event_type <> 'error') * 100.0 / count(*), 6) FROM events) AS success_rate FROM j""")
def latency_summary(spark, folder):
    rows = table(spark, folder, "events").withColumn("ok", F.col("event_type") != "error")
    return rounded(rounded(runlog.latency_summary(rows, "value", "ok"), 9, "avg_latency"), 6, "p95_latency", "success_rate")
