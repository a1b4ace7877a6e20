"""Run-log analytics.

A run is (workflow_name, status, start_time, duration_seconds, total_tasks, completed_tasks,
failed_tasks, error_message).
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillon.functions.ordering import Pick, indexed_quantile, quantiles, value_at
from quillon.functions.timeline import with_previous

HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US


def _us(column: Column) -> Column:
    return F.unix_micros(column.cast("timestamp"))


def run_metrics(runs: DataFrame) -> DataFrame:
    """Counts by status, success rate, duration and task figures per workflow."""
    n = F.count(F.lit(1))
    took = F.when(F.col("duration_seconds") != 0, F.col("duration_seconds"))
    done, failed = F.sum("completed_tasks"), F.sum("failed_tasks")
    zero = lambda column: F.coalesce(column, F.lit(0.0))
    return runs.groupBy("workflow_name").agg(
        n.alias("total_executions"),
        F.count_if(F.col("status") == "success").alias("successful_executions"),
        F.count_if(F.col("status") == "failed").alias("failed_executions"),
        F.count_if(F.col("status") == "cancelled").alias("cancelled_executions"),
        (F.count_if(F.col("status") == "success") * 100.0 / n).alias("success_rate"),
        zero(F.avg(took)).alias("avg_duration_seconds"),
        zero(F.min(took).cast("double")).alias("min_duration_seconds"),
        zero(F.max(took).cast("double")).alias("max_duration_seconds"),
        F.coalesce(F.sum("total_tasks"), F.lit(0)).alias("total_tasks_executed"),
        zero(F.sum("total_tasks") / n).alias("avg_tasks_per_workflow"),
        zero(F.try_divide(done * 100.0, done + failed)).alias("task_success_rate"),
    )


def common_errors(runs: DataFrame, n: int = 5) -> DataFrame:
    """The n most frequent errors of failed runs, by first line and 100 characters; ties by text."""
    first_line = F.substring(F.substring_index("error_message", "\n", 1), 1, 100)
    failed = runs.filter((F.col("status") == "failed") & (F.col("error_message") != ""))
    return (
        failed.groupBy(first_line.alias("error"))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "error")
        .limit(n)
    )


def hourly_counts(runs: DataFrame, end: dt.datetime | str) -> DataFrame:
    """Runs in each of the 24 hours before `end`; hour 23 is the latest, empty hours are 0."""
    ago = F.floor((_us(F.lit(end)) - _us(F.col("start_time"))) / F.lit(HOUR_US))
    counted = (
        runs.filter((F.col("start_time") <= F.lit(end).cast("timestamp")) & (F.col("start_time") > F.lit(end).cast("timestamp") - F.make_dt_interval(hours=F.lit(24))))
        .groupBy((F.lit(23) - ago).cast("int").alias("hour_slot"))
        .agg(F.count(F.lit(1)).alias("executions"))
    )
    spine = runs.sparkSession.range(24).select(F.col("id").cast("int").alias("hour_slot"))
    return spine.join(counted, "hour_slot", "left").na.fill(0, ["executions"])


def daily_success(runs: DataFrame, end: dt.datetime | str) -> DataFrame:
    """Success rate of each of the 7 calendar days before the day of `end`; 0 for an empty day."""
    today = F.to_date(F.lit(end).cast("timestamp"))
    day = F.to_date("start_time")
    rates = (
        runs.filter((day >= F.date_sub(today, 7)) & (day < today))
        .groupBy(day.alias("day"))
        .agg((F.count_if(F.col("status") == "success") * 100.0 / F.count(F.lit(1))).alias("success_rate"))
    )
    spine = runs.sparkSession.range(7).select(F.date_sub(today, F.lit(7) - F.col("id").cast("int")).alias("day"))
    return spine.join(rates, "day", "left").na.fill(0.0, ["success_rate"])


def with_health(metrics: DataFrame) -> DataFrame:
    """Add health_score 0..100 and health_status to run metrics."""
    below = lambda value, line, weight: F.greatest(F.lit(line) - F.col(value), F.lit(0.0)) * weight
    n = F.col("total_executions")
    error_rate = F.coalesce(F.try_divide(F.col("failed_executions") * 100.0, n), F.lit(0.0))
    slow = F.greatest((F.col("avg_duration_seconds") - 3600) / 3600 * 20, F.lit(0.0))
    score = (
        F.lit(100.0)
        - below("success_rate", 95.0, 0.4)
        - F.greatest(error_rate - 5, F.lit(0.0)) * 0.2
        - F.least(slow, F.lit(20.0))
        - F.when(n == 0, 10.0).otherwise(0.0)
        - below("task_success_rate", 95.0, 0.1)
    )
    return metrics.withColumn("health_score", F.greatest(F.least(score, F.lit(100.0)), F.lit(0.0))).withColumn(
        "health_status",
        F.when(F.col("health_score") >= 90, "healthy").when(F.col("health_score") >= 70, "degraded").otherwise("unhealthy"),
    )


def recurring_failures(runs: DataFrame, at_least: int = 3) -> DataFrame:
    """Error patterns per workflow (first three words longer than five letters) that repeat."""
    failed = runs.filter((F.col("status") == "failed") & (F.col("error_message") != ""))
    words = F.filter(F.split(F.trim("error_message"), r"\s+"), lambda word: F.length(word) > 5)
    pattern = F.array_join(F.slice(words, 1, 3), " ")
    return (
        failed.groupBy("workflow_name", pattern.alias("pattern"))
        .agg(F.count(F.lit(1)).alias("occurrences"))
        .filter(F.col("occurrences") >= at_least)
    )


def declining(daily: DataFrame) -> DataFrame:
    """One row: did the success rate strictly fall over the last three days?"""
    in_order = Window.orderBy("day")  # seven rows
    falls = daily.withColumn("_fell", F.lag("success_rate").over(in_order) > F.col("success_rate")).withColumn(
        "_back", F.row_number().over(Window.orderBy(F.desc("day")))
    )
    return falls.filter(F.col("_back") <= 2).agg((F.count_if("_fell") == 2).alias("declining"))


def performance_issues(metrics: DataFrame) -> DataFrame:
    """(workflow_name, issue) for slow, uneven or failing task figures."""
    issues = F.array_compact(
        F.array(
            F.when(F.col("avg_duration_seconds") > 3600, F.lit("High average duration")),
            F.when(F.col("max_duration_seconds") > F.col("avg_duration_seconds") * 3, F.lit("High duration variability detected")),
            F.when(F.col("task_success_rate") < 90, F.lit("Low task success rate")),
        )
    )
    return metrics.select("workflow_name", F.explode(issues).alias("issue"))


@dataclass(frozen=True)
class RunRule:
    name: str
    severity: str = "medium"
    workflow_name: str | None = None
    evaluation_minutes: int = 60
    success_rate: float | None = None
    duration_seconds: float | None = None
    error_count: int | None = None
    failure_streak: int | None = None


def run_alerts(runs: DataFrame, rule: RunRule, now: dt.datetime | str, tie: str) -> DataFrame:
    """One row with the measured values and fired conditions when any condition holds, else none."""
    period = runs.filter(
        F.col("start_time") >= F.lit(now).cast("timestamp") - F.make_dt_interval(mins=F.lit(rule.evaluation_minutes))
    )
    if rule.workflow_name:
        period = period.filter(F.col("workflow_name") == rule.workflow_name)
    n = F.count(F.lit(1))
    took = F.when(F.col("duration_seconds") != 0, F.col("duration_seconds"))
    row = period.agg(
        n.alias("executions"),
        F.try_divide(F.count_if(F.col("status") == "success") * 100.0, n).alias("success_rate"),
        F.avg(took).alias("avg_duration"),
        F.count_if(F.col("status") == "failed").alias("error_count"),
    )
    if rule.failure_streak is not None:
        # The runs after the newest one that did not fail, counted without a sort.
        place = F.struct("start_time", tie)
        last_good = period.agg(F.max(F.when(F.col("status") != "failed", place))).scalar()
        newer = period.agg(F.count_if(last_good.isNull() | (place > last_good)).cast("int")).scalar()
        row = row.withColumn("failure_streak", newer)
    else:
        row = row.withColumn("failure_streak", F.lit(None).cast("int"))
    tests = []
    if rule.success_rate is not None:
        tests.append(F.when(F.col("success_rate") < rule.success_rate, F.lit("success_rate")))
    if rule.duration_seconds is not None:
        tests.append(F.when(F.col("avg_duration") > rule.duration_seconds, F.lit("duration")))
    if rule.error_count is not None:
        tests.append(F.when(F.col("error_count") > rule.error_count, F.lit("error_count")))
    if rule.failure_streak is not None:
        tests.append(F.when(F.col("failure_streak") >= rule.failure_streak, F.lit("failure_streak")))
    fired = F.array_compact(F.array(*tests)) if tests else F.array().cast("array<string>")
    return (
        row.withColumn("rule_name", F.lit(rule.name))
        .withColumn("severity", F.lit(rule.severity))
        .withColumn("triggered_conditions", fired)
        .filter((F.col("executions") > 0) & (F.size("triggered_conditions") > 0))
    )


@dataclass(frozen=True)
class MetricRule:
    name: str
    metric_name: str
    condition: str
    threshold: float


# How close counts as equal.
EQUALITY_TOLERANCE = 0.001


def rule_holds(value: Column, condition: str, threshold: float) -> Column:
    near = F.abs(value - threshold) < EQUALITY_TOLERANCE
    tests = {"greater_than": value > threshold, "less_than": value < threshold, "equals": near, "not_equals": ~near}
    if condition not in tests:
        raise ValueError(f"Unknown condition: {condition}")
    return tests[condition]


def readings_by_rule(readings: DataFrame, rules: list[MetricRule]) -> DataFrame:
    """Readings (metric_name, value, ...) once per rule on that metric, with `holds`."""
    named = [
        F.when(
            F.col("metric_name") == rule.metric_name,
            F.struct(F.lit(rule.name).alias("rule_name"), rule_holds(F.col("value"), rule.condition, rule.threshold).alias("holds")),
        )
        for rule in rules
    ]
    present = readings.filter(F.col("value").isNotNull())
    return present.select("*", F.explode(F.array_compact(F.array(*named))).alias("_r")).select(*readings.columns, "_r.*")


def metric_alerts(readings: DataFrame, rules: list[MetricRule], time: str, tie: str, slice_seconds: int = 3_600) -> DataFrame:
    """Transitions per rule: triggered, updated while it stays on, resolved."""
    rows = readings_by_rule(readings, rules)
    looked = with_previous(rows, ["rule_name"], time, tie, F.col("holds"), "_was", slice_seconds)
    was = F.coalesce("_was", F.lit(False))
    change = (
        F.when(F.col("holds") & ~was, "triggered").when(F.col("holds") & was, "updated").when(~F.col("holds") & was, "resolved")
    )
    return looked.withColumn("transition", change).filter(F.col("transition").isNotNull()).drop("_was", "holds")


def latency_summary(df: DataFrame, latency: str, ok: str) -> DataFrame:
    """Average, p95 (19th of 20 exclusive quantiles), p99 (by index) and success rate in percent."""
    n = F.col("n_total")
    spot = (n + 1) * 19
    at = F.greatest(F.lit(1), F.least(F.floor(spot / 20), n - 1))
    weight = spot - at * 20
    low, high = at - 1, F.least(at, n - 1)
    between = (value_at(latency, low) * (20 - F.max(weight)) + value_at(latency, high) * F.max(weight)) / 20
    picks = quantiles(df, [], latency, {"p95": Pick(between, (low, high)), "p99": indexed_quantile(latency, 99)})
    rates = df.agg(
        F.coalesce(F.avg(latency), F.lit(0.0)).alias("avg_latency"),
        F.coalesce(F.avg(F.col(ok).cast("double")) * 100, F.lit(0.0)).alias("success_rate"),
        F.count(F.lit(1)).alias("total_events"),
    )
    pair = picks.select(F.struct("p95", "p99")).scalar()
    return rates.withColumn("_p", pair).select(
        "total_events",
        "avg_latency",
        F.coalesce("_p.p95", F.lit(0.0)).alias("p95_latency"),
        F.coalesce("_p.p99", F.lit(0.0)).alias("p99_latency"),
        "success_rate",
    )


def search_runs(runs: DataFrame, where: str | None = None, order: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Runs by a SQL condition, in the order of columns (`name` or `name desc`); all of them unless a limit is given."""
    found = runs if where is None else runs.filter(where)
    if order:
        found = found.orderBy(*[F.desc(c.removesuffix(" desc")) if c.endswith(" desc") else F.col(c) for c in order])
    return found if limit is None else found.limit(limit)


def overview(runs: DataFrame, now: dt.datetime | str) -> DataFrame:
    """One row over the whole run log: workflows, runs, those of the last 24 hours, and both success rates in percent."""
    recent = F.col("start_time") >= F.lit(now).cast("timestamp") - F.make_dt_interval(hours=F.lit(24))
    good = F.col("status") == "success"
    return runs.agg(
        F.count_distinct("workflow_name").alias("workflows"),
        F.count(F.lit(1)).alias("executions"),
        F.count_if(recent).alias("executions_24h"),
        F.try_divide(F.count_if(good) * 100.0, F.count(F.lit(1))).alias("success_rate"),
        F.try_divide(F.count_if(good & recent) * 100.0, F.count_if(recent)).alias("success_rate_24h"),
    )
