"""Experiments: who sees which variant, what the variants measured, and when to stop."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from quillon.functions.hashing import md5_mod, percent_bucket, pick_by_share
from quillon.functions.ordering import linear_quantile, quantiles


# -- assignment -------------------------------------------------------------------------------


def variant_of(user: Column, experiment_id: str, variants: list[tuple[str, float]]) -> Column:
    """Variant by the md5 of `experiment:user`; shares are percentages, bounds inclusive."""
    point = percent_bucket(F.concat(F.lit(f"{experiment_id}:"), user.cast("string")))
    return pick_by_share(point, variants, inclusive=True)


def eligible(df: DataFrame, audience: dict[str, Any], exclusions: dict[str, Any]) -> Column:
    """Equality rules on attributes. An attribute the row lacks, or null, passes."""
    kept = F.lit(True)
    for name, value in audience.items():
        if name in df.columns:
            kept = kept & F.coalesce(F.col(name) == F.lit(value), F.lit(True))
    for name, value in exclusions.items():
        if name in df.columns:
            kept = kept & F.coalesce(F.col(name) != F.lit(value), F.lit(True))
    return kept


def assign(
    users: DataFrame,
    user: str,
    experiment_id: str,
    variants: list[tuple[str, float]],
    existing: DataFrame | None = None,
    audience: dict[str, Any] | None = None,
    exclusions: dict[str, Any] | None = None,
) -> DataFrame:
    """Eligible users with their variant. An existing assignment (user, variant) wins."""
    rows = users.filter(eligible(users, audience or {}, exclusions or {}))
    computed = variant_of(F.col(user), experiment_id, variants)
    if existing is None:
        return rows.withColumn("variant", computed).filter(F.col("variant").isNotNull())
    kept = existing.groupBy(user).agg(F.min("variant").alias("_kept"))
    return (
        rows.join(kept, user, "left")
        .withColumn("variant", F.coalesce("_kept", computed))
        .drop("_kept")
        .filter(F.col("variant").isNotNull())
    )


def attribute(events: DataFrame, assignments: DataFrame, user: str) -> DataFrame:
    """Events of assigned users, with the variant. Assignments are one row per user."""
    return events.join(assignments.select(user, "variant"), user)


# -- measurement ------------------------------------------------------------------------------


def metric_values(events: DataFrame, primary_metric: str) -> DataFrame:
    """(variant, value): the numeric value, or 1.0 for a primary event without one."""
    value = F.coalesce(
        F.col("event_value").cast("double"), F.when(F.col("event_type") == primary_metric, F.lit(1.0))
    )
    return events.select("variant", value.alias("value")).filter(F.col("value").isNotNull())


def user_conversions(assignments: DataFrame, events: DataFrame, user: str, primary_metric: str) -> DataFrame:
    """(variant, value): one row per assigned user, 1.0 when the user had a primary event, else 0.0."""
    converted = (
        events.filter(F.col("event_type") == primary_metric).select(user).distinct().withColumn("_hit", F.lit(1.0))
    )
    return assignments.join(converted, user, "left").select("variant", F.coalesce("_hit", F.lit(0.0)).alias("value"))


def variant_stats(values: DataFrame, variants: list[str], with_median: bool = True) -> DataFrame:
    """Size, mean, sample deviation, variance and exact median per variant; 0 where there is no data."""
    result = values.groupBy("variant").agg(
        F.count("value").alias("sample_size"),
        F.avg("value").alias("mean"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"),
        F.coalesce(F.var_samp("value"), F.lit(0.0)).alias("var"),
    )
    if with_median:
        median = quantiles(values, ["variant"], "value", {"median": linear_quantile("value", 0.5)})
        result = result.join(median, "variant")
    spine = values.sparkSession.createDataFrame([(v,) for v in variants], "variant string")
    return spine.join(result, "variant", "left").na.fill(0)


def variant_pairs(stats: DataFrame, variants: list[str]) -> DataFrame:
    """Every ordered-once pair of variants with both sides' n, mean and var. Empty sides drop out.

    The stats are one row per variant, so they fit one map; no join of rows with rows.
    """
    by_name = stats.agg(
        F.map_from_entries(
            F.collect_list(
                F.struct("variant", F.struct(F.col("sample_size").alias("n"), F.col("mean").alias("m"), F.col("var").alias("v")))
            )
        ).alias("_s")
    )
    pairs = [(a, b) for at, a in enumerate(variants) for b in variants[at + 1 :]]
    rows = by_name.select(
        F.explode(F.array(*[F.struct(F.lit(a).alias("variant_a"), F.lit(b).alias("variant_b")) for a, b in pairs])).alias("p"),
        "_s",
    ).select("p.*", "_s")
    sides = {"a": F.try_element_at("_s", F.col("variant_a")), "b": F.try_element_at("_s", F.col("variant_b"))}
    return rows.select(
        "variant_a",
        "variant_b",
        *[value.getField(part).alias(f"{part}_{side}") for side, value in sides.items() for part in ("n", "m", "v")],
    ).filter((F.col("n_a") > 0) & (F.col("n_b") > 0))


def winner(stats: DataFrame, tests: DataFrame) -> DataFrame:
    """The variant with the highest mean, and 1 - the least p-value as confidence."""
    best = stats.agg(F.max(F.struct("mean", "variant")).getField("variant").alias("winner"))
    sure = tests.agg((1 - F.min("p_value")).alias("confidence"))
    return best.withColumn("confidence", sure.scalar())


def stopping(
    stats: DataFrame, tests: DataFrame, min_sample_size: int, max_days: int, start: dt.datetime, now: dt.datetime
) -> DataFrame:
    """One row (should_stop, reason): too few samples, then duration, then significance."""
    days = (now - start).days
    short = stats.filter(F.col("sample_size") < min_sample_size).agg(F.min("variant")).scalar()
    hit = (
        tests.filter("is_significant")
        .agg(F.min(F.concat_ws("_vs_", "variant_a", "variant_b")))
        .scalar()
    )
    row = stats.sparkSession.range(1).select(short.alias("short"), hit.alias("hit"))
    return row.select(
        F.when(F.col("short").isNotNull(), F.lit(False))
        .otherwise(F.lit(days >= max_days) | F.col("hit").isNotNull())
        .alias("should_stop"),
        F.when(F.col("short").isNotNull(), F.concat(F.lit("Insufficient sample size for "), "short"))
        .when(F.lit(days >= max_days), F.lit(f"Maximum duration reached: {days} days"))
        .when(F.col("hit").isNotNull(), F.concat(F.lit("Statistical significance achieved for "), "hit"))
        .otherwise(F.lit("Stopping criteria not met"))
        .alias("reason"),
    )


# -- flags and traffic ------------------------------------------------------------------------


@dataclass(frozen=True)
class TargetRule:
    conditions: dict[str, Any]
    value: str
    priority: int = 100


@dataclass(frozen=True)
class Flag:
    key: str
    default: str = "false"
    current: str | None = None
    active: bool = True
    rules: tuple[TargetRule, ...] = ()
    test_name: str | None = None
    test_variants: dict[str, str] = field(default_factory=dict)
    test_shares: tuple[tuple[str, float], ...] = ()
    percentage: float = 0.0


def flag_value(df: DataFrame, user: str, flag: Flag) -> Column:
    """Value of a flag per row: target rules by priority, A/B test, percentage rollout, default.

    Columns of `df` are the user's attributes. A condition `attr_x` needs the attribute to be
    present and equal; a plain `x` is checked only where present.
    """
    if not flag.active:
        return F.lit(flag.default)
    known_user = F.coalesce(F.col(user).cast("string"), F.lit("")) != ""
    value = F.lit(flag.default)
    if flag.percentage > 0:
        point = percent_bucket(F.concat(F.lit(f"{flag.key}:"), F.col(user).cast("string")))
        value = F.when(known_user & (point <= flag.percentage), F.lit(flag.current or "true")).otherwise(value)
    if flag.test_name:
        point = percent_bucket(F.concat(F.lit(f"{flag.key}:"), F.col(user).cast("string"), F.lit(f":{flag.test_name}")))
        variant = F.when(known_user, pick_by_share(point, list(flag.test_shares), inclusive=True))
        shown = F.lit(None).cast("string")
        for name, text in flag.test_variants.items():
            shown = F.when(variant == name, F.lit(text)).otherwise(shown)
        value = F.coalesce(shown, value)
    for rule in sorted(flag.rules, key=lambda r: r.priority):
        value = F.when(_rule_holds(df, user, rule), F.lit(rule.value)).otherwise(value)
    return value


def _rule_holds(df: DataFrame, user: str, rule: TargetRule) -> Column:
    holds = F.lit(True)
    for name, wanted in rule.conditions.items():
        if name == "user_id":
            test = F.coalesce(F.col(user) == F.lit(wanted), F.lit(False))
        elif name == "user_ids":
            test = F.coalesce(F.col(user).isin(list(wanted)), F.lit(False))
        elif name.startswith("attr_"):
            attribute = name.removeprefix("attr_")
            test = F.coalesce(F.col(attribute) == F.lit(wanted), F.lit(False)) if attribute in df.columns else F.lit(False)
        else:
            test = F.coalesce(F.col(name) == F.lit(wanted), F.lit(True)) if name in df.columns else F.lit(True)
        holds = holds & test
    return holds


def traffic_variant(user: Column, experiment_id: str, shares: list[tuple[str, float]], control: str) -> Column:
    """Model traffic split: md5 modulo 100 below the running share, else the control."""
    point = md5_mod(F.concat(F.lit(f"{experiment_id}:"), user.cast("string")), 100)
    return F.coalesce(pick_by_share(point, shares, inclusive=False), F.lit(control))


def rollout_shares(
    shares: list[tuple[str, float]], control: str, start: dt.datetime, now: dt.datetime, planned_days: int
) -> list[tuple[str, float]]:
    """Gradual rollout: treatments grow with the elapsed share of the plan, control takes the rest."""
    progress = min((now - start).total_seconds() / dt.timedelta(days=planned_days).total_seconds(), 1.0)
    grown = {name: share * progress for name, share in shares if name != control}
    return [(name, grown.get(name, 100 - sum(grown.values()))) for name, _ in shares]


def in_audience(user: Column, percentage: float, segments: Column | None = None, required: list[str] | None = None) -> Column:
    """Audience filter: any required segment, and md5 modulo 100 plus 1 within the percentage."""
    kept = md5_mod(user, 100) + 1 <= percentage
    if segments is not None and required:
        kept = kept & F.arrays_overlap(segments, F.array(*[F.lit(name) for name in required]))
    return kept


# -- runs and versions ------------------------------------------------------------------------


def run_matrix(pairs: DataFrame, runs: list[str]) -> DataFrame:
    """Metric or parameter matrix: (run_id, key, value) to one row per key, one column per run."""
    return pairs.filter(F.col("run_id").isin(runs)).groupBy("key").pivot("run_id", runs).agg(F.max("value"))


def parameter_agreement(params: DataFrame) -> DataFrame:
    """Per parameter: how many runs set it, whether they agree, and the common value."""
    return params.groupBy("key").agg(
        F.count(F.lit(1)).alias("run_count"),
        (F.min("value") == F.max("value")).alias("is_common"),
        F.when(F.min("value") == F.max("value"), F.min("value")).alias("common_value"),
    )


def compare_versions(metrics: DataFrame, first: str, second: str) -> DataFrame:
    """Per model and metric set in both versions: values, difference and percent change."""
    sides = metrics.filter(F.col("version").isin(first, second)).groupBy("model", "metric").agg(
        F.max(F.when(F.col("version") == first, F.col("value"))).alias("version1_value"),
        F.max(F.when(F.col("version") == second, F.col("value"))).alias("version2_value"),
    )
    change = F.col("version2_value") - F.col("version1_value")
    return (
        sides.filter(F.col("version1_value").isNotNull() & F.col("version2_value").isNotNull())
        .withColumn("difference", change)
        .withColumn("percentage_change", F.coalesce(F.try_divide(change, F.col("version1_value")) * 100, F.lit(0.0)))
    )


def stale_failures(runs: DataFrame, now: dt.datetime | str, days: int = 7) -> DataFrame:
    """Failed runs that started more than `days` ago."""
    cutoff = F.lit(now).cast("timestamp") - F.make_dt_interval(days=F.lit(days))
    return runs.filter((F.col("status") == "FAILED") & (F.col("start_time") < cutoff))


def metric_history(metrics: DataFrame, run, key: str) -> DataFrame:
    """All values (step, value) of one metric of a run, by step."""
    return metrics.filter((F.col("run_id") == F.lit(run)) & (F.col("key") == key)).orderBy("step", "value")


def newest_metrics(metrics: DataFrame) -> DataFrame:
    """(run_id, key, value, step): the value of the last step of each metric, the largest of several."""
    last = F.max(F.struct("step", "value"))
    return metrics.groupBy("run_id", "key").agg(last.alias("_l")).select("run_id", "key", F.col("_l.value").alias("value"), F.col("_l.step").alias("step"))
