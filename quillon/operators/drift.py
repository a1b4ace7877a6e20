"""Baselines and drift, per feature, over long rows (feature_name, value).

Baseline and current rows go through one aggregation with a column for each side, so no two
large sides are joined.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from quillon.functions.ordering import at_position, ordered_counts, quantiles
from quillon.functions.tails import kolmogorov_exact_p, chi_square_p, kolmogorov_p
from quillon.session import checkpointed

EPSILON = 1e-6
BASELINE_PERCENTS = (25, 50, 75, 90, 95, 99)


# -- baselines --------------------------------------------------------------------------------


def numeric_baseline(rows: DataFrame) -> DataFrame:
    """Per feature: count, mean, std, min, max, percentiles, null percentage, distinct values.

    Text that reads as a number counts as one. A percentile is the row at int(p/100 * (n-1)).
    """
    value = F.col("value").try_cast("double") if isinstance(rows.schema["value"].dataType, T.StringType) else F.col("value").cast("double")
    numbers = rows.select("feature_name", "value", value.alias("_v"))
    moments = numbers.groupBy("feature_name").agg(
        F.count(F.lit(1)).alias("count"),
        F.avg("_v").alias("mean"),
        F.coalesce(F.stddev_samp("_v"), F.lit(0.0)).alias("std"),
        F.min("_v").alias("min_val"),
        F.max("_v").alias("max_val"),
        (F.avg(F.col("value").isNull().cast("double")) * 100).alias("null_percentage"),
    )
    picks = {f"p{p}": at_position("_v", F.floor(F.lit(p / 100) * (F.col("n_total") - 1))) for p in BASELINE_PERCENTS}
    ranks = quantiles(numbers, ["feature_name"], "_v", picks)
    unique = numbers.where(F.col("_v").isNotNull()).select("feature_name", "_v").distinct().groupBy("feature_name").agg(F.count(F.lit(1)).alias("unique_values"))
    found = moments.join(ranks, "feature_name", "left").join(unique, "feature_name", "left")
    return found.na.fill(0, ["unique_values"])


def categorical_baseline(rows: DataFrame) -> DataFrame:
    """Counts of each value as text, per feature."""
    return (
        rows.filter(F.col("value").isNotNull())
        .groupBy("feature_name", F.col("value").cast("string").alias("category"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


# -- feature-store drift ----------------------------------------------------------------------


def numeric_drift(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Drift score from two numeric baselines: mean of the two changes in units of std, at most 1."""
    side = lambda df, mark: df.select("feature_name", F.col("mean").alias(f"mean_{mark}"), F.col("std").alias(f"std_{mark}"))
    both = side(baseline, "base").join(side(current, "now"), "feature_name")
    mean_shift = F.abs(F.col("mean_now") - F.col("mean_base"))
    change = (mean_shift + F.abs(F.col("std_now") - F.col("std_base"))) / (2 * F.col("std_base"))
    return both.select(
        "feature_name",
        "mean_base", "mean_now", "std_base", "std_now",
        mean_shift.alias("mean_shift"),
        F.coalesce(F.try_divide(F.col("std_now"), F.col("std_base")), F.lit(0.0)).alias("std_ratio"),
        F.when(F.col("std_base") > 0, F.least(change, F.lit(1.0))).otherwise(F.lit(0.0)).alias("drift_score"),
    )


def category_shares(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """(feature_name, category, n_base, n_now, share_base, share_now) over both sets of rows."""
    mark = lambda df, base: df.filter(F.col("value").isNotNull()).select(
        "feature_name", F.col("value").cast("string").alias("category"), F.lit(base).alias("_base")
    )
    counted = (
        mark(baseline, True)
        .unionAll(mark(current, False))
        .groupBy("feature_name", "category")
        .agg(F.count_if("_base").alias("n_base"), F.count_if(~F.col("_base")).alias("n_now"))
    )
    totals = counted.groupBy("feature_name").agg(F.sum("n_base").alias("_t_base"), F.sum("n_now").alias("_t_now"))
    return counted.join(totals, "feature_name").select(
        "feature_name", "category", "n_base", "n_now",
        F.col("_t_base").alias("total_base"),
        F.col("_t_now").alias("total_now"),
        F.try_divide(F.col("n_base").cast("double"), F.col("_t_base")).alias("share_base"),
        F.try_divide(F.col("n_now").cast("double"), F.col("_t_now")).alias("share_now"),
    )


def _psi_term(base: Column, now: Column) -> Column:
    return (now - base) * F.log(now / base)


def categorical_drift(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """PSI with shares floored at 1e-6, at most 1; also how many categories are new or gone."""
    shares = category_shares(baseline, current)
    term = _psi_term(F.greatest("share_base", F.lit(EPSILON)), F.greatest("share_now", F.lit(EPSILON)))
    both = (F.col("total_base") > 0) & (F.col("total_now") > 0)
    return shares.groupBy("feature_name").agg(
        F.least(F.coalesce(F.sum(F.when(both, term)), F.lit(0.0)), F.lit(1.0)).alias("drift_score"),
        F.count_if(F.col("n_base") == 0).alias("new_categories"),
        F.count_if(F.col("n_now") == 0).alias("missing_categories"),
    )


def _as_categories(df: DataFrame, columns: list[str]) -> DataFrame:
    return long_features(df, columns).withColumn("value", F.col("value").cast("string"))


def category_changes(baseline: DataFrame, current: DataFrame, categorical: list[str]) -> DataFrame:
    """(feature_name, category, change): each category of the named columns that is new or missing, a row for each."""
    shares = category_shares(_as_categories(baseline, categorical), _as_categories(current, categorical))
    change = F.when(F.col("n_base") == 0, "new").when(F.col("n_now") == 0, "missing")
    return shares.select("feature_name", "category", change.alias("change")).where(F.col("change").isNotNull())


def changed_names(changes: DataFrame) -> DataFrame:
    """(feature_name, new_categories, missing_categories): the names of `category_changes` as one sorted list of each kind."""
    names = lambda change: F.array_sort(F.collect_list(F.when(F.col("change") == change, F.col("category"))))
    return changes.groupBy("feature_name").agg(names("new").alias("new_categories"), names("missing").alias("missing_categories"))


def feature_drift(baseline: DataFrame, current: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """Drift of the named columns of two tables, each by its kind, with status, alert level and changed categories.

    (feature_name, kind, drift_score, new_categories, missing_categories, drift_status, alert_level); the last but two
    are counts, 0 for numbers. `category_changes` names the categories, `changed_names` in one row.
    """
    parts = []
    if numeric:
        sides = [numeric_baseline(long_features(df, numeric)) for df in (baseline, current)]
        none = [F.lit(0).cast("long").alias(c) for c in ("new_categories", "missing_categories")]
        parts.append(numeric_drift(*sides).select("feature_name", F.lit("numeric").alias("kind"), "drift_score", *none))
    if categorical:
        scores = categorical_drift(_as_categories(baseline, categorical), _as_categories(current, categorical))
        parts.append(scores.withColumn("kind", F.lit("categorical")))
    return with_drift_status(reduce(DataFrame.unionByName, parts))


def with_drift_status(scores: DataFrame, low: float = 0.1, medium: float = 0.3, high: float = 0.5) -> DataFrame:
    """Add the drift status and, from low drift on, the alert level."""
    score = F.col("drift_score")
    status = (
        F.when(score >= high, "high_drift").when(score >= medium, "medium_drift").when(score >= low, "low_drift").otherwise("no_drift")
    )
    level = F.when(F.col("drift_status") == "high_drift", "error").when(F.col("drift_status") != "no_drift", "warning")
    return scores.withColumn("drift_status", status).withColumn("alert_level", level)


def drift_history(detections: DataFrame, feature: str, now: dt.datetime | str, days: int = 30) -> DataFrame:
    """Detections of a feature in the last days, newest first."""
    cutoff = F.lit(now).cast("timestamp") - F.make_dt_interval(days=F.lit(days))
    return detections.filter((F.col("feature_name") == feature) & (F.col("created_at") >= cutoff)).orderBy(
        F.desc("created_at")
    )


def find_alerts(
    alerts: DataFrame, feature: str | None = None, level: str | None = None, acknowledged: bool | None = None, limit: int | None = None
) -> DataFrame:
    """Stored alerts by feature, level and acknowledgement, newest first."""
    rows = alerts
    if feature is not None:
        rows = rows.filter(F.col("feature_name") == feature)
    if level is not None:
        rows = rows.filter(F.col("alert_level") == level)
    if acknowledged is not None:
        rows = rows.filter(F.col("acknowledged") == acknowledged)
    rows = rows.orderBy(F.desc("created_at"), *[c for c in ("id",) if c in alerts.columns])
    return rows if limit is None else rows.limit(limit)


# -- model-input drift ------------------------------------------------------------------------


def _sided(reference: DataFrame, current: DataFrame) -> DataFrame:
    """Finite numbers of both sides as (feature_name, value, is_reference)."""
    mark = lambda df, own: df.select("feature_name", F.col("value").cast("double").alias("value"), F.lit(own).alias("is_reference"))
    rows = mark(reference, True).unionAll(mark(current, False))
    infinite = F.abs("value") == F.lit(float("inf"))
    return rows.filter(F.col("value").isNotNull() & ~F.isnan("value") & ~infinite)


def _ordered_sides(reference: DataFrame, current: DataFrame) -> DataFrame:
    counts = {
        "n": F.count(F.lit(1)),
        "ref": F.count_if("is_reference"),
        "cur": F.count_if(~F.col("is_reference")),
    }
    return ordered_counts(_sided(reference, current), ["feature_name"], "value", counts)


def kolmogorov_smirnov(reference: DataFrame, current: DataFrame, min_rows: int = 5, exact_up_to: int = 10_000) -> DataFrame:
    """Largest gap of the two distribution functions per feature, with its p-value.

    The p-value is exact while neither side has more than `exact_up_to` rows, and that of the limit beyond. Too few rows give (0, 1); two different constants give (1, 0).
    """
    ordered = _ordered_sides(reference, current)
    up_to = lambda side: F.try_divide((F.col(f"{side}_before") + F.col(side)).cast("double"), F.col(f"{side}_total"))
    sums = ordered.groupBy("feature_name").agg(
        F.max(F.abs(up_to("ref") - up_to("cur"))).alias("gap"),
        F.max("ref_total").alias("reference_samples"),
        F.max("cur_total").alias("current_samples"),
        F.count_if(F.col("ref") > 0).alias("_ref_values"),
        F.count_if(F.col("cur") > 0).alias("_cur_values"),
    )
    n, m = F.col("reference_samples").cast("double"), F.col("current_samples").cast("double")
    few = (n < min_rows) | (m < min_rows)
    constants = (F.col("_ref_values") == 1) & (F.col("_cur_values") == 1)
    gap = F.when(few, F.lit(0.0)).otherwise(F.col("gap"))
    exact = F.greatest(n, m) <= exact_up_to
    spot = lambda column: F.when(exact & ~few & ~constants, column)
    tail = F.coalesce(kolmogorov_exact_p(spot(F.col("statistic")), spot(n), spot(m)), kolmogorov_p(F.col("statistic") * F.sqrt(n * m / (n + m))))
    return (
        sums.withColumn("statistic", gap)
        .withColumn("_tail", tail)
        .withColumn(
            "p_value",
            F.when(few, 1.0)
            .when(constants, F.when(F.col("gap") == 0, 1.0).otherwise(0.0))
            .otherwise(F.col("_tail")),
        )
        .select("feature_name", "statistic", "p_value", "reference_samples", "current_samples")
    )


def categorical_chi_square(reference: DataFrame, current: DataFrame) -> DataFrame:
    """Goodness of fit of the current counts to the reference counts scaled to the same total.

    A category that the reference never had makes the statistic infinite.
    """
    shares = category_shares(reference, current)
    expected = F.col("share_base") * F.col("total_now")
    term = F.when(expected > 0, (F.col("n_now") - expected) ** 2 / expected).when(F.col("n_now") > 0, float("inf"))
    sums = shares.groupBy("feature_name").agg(
        F.sum(term).alias("statistic"),
        (F.count(F.lit(1)) - 1).cast("double").alias("degrees_of_freedom"),
        F.max("total_base").alias("reference_samples"),
        F.max("total_now").alias("current_samples"),
    )
    finite = F.col("statistic") < float("inf")
    tail = chi_square_p(F.when(finite, F.col("statistic")), F.greatest("degrees_of_freedom", F.lit(1.0)))
    return sums.withColumn("_tail", tail).withColumn(
        "p_value",
        F.when(F.col("degrees_of_freedom") < 1, 1.0).when(finite, F.col("_tail")).otherwise(0.0),
    ).drop("_tail")


def categorical_psi(reference: DataFrame, current: DataFrame) -> DataFrame:
    """PSI over category shares; a category absent from one side counts as 1e-6 there."""
    shares = category_shares(reference, current)
    share = lambda side: F.when(F.col(f"n_{side}") > 0, F.col(f"share_{side}")).otherwise(F.lit(EPSILON))
    return shares.groupBy("feature_name").agg(
        F.abs(F.sum(_psi_term(share("base"), share("now")))).alias("psi"),
        F.max("total_base").alias("reference_samples"),
        F.max("total_now").alias("current_samples"),
    )


def numeric_psi(reference: DataFrame, current: DataFrame, min_rows: int = 10, max_bins: int = 10) -> DataFrame:
    """PSI over quantile bins of the reference: 3 to 10 bins by the root of the smaller side.

    Edges are exact interpolated quantiles. Values outside the edges are dropped; the last bin
    is closed. Fewer than three distinct edges fall back to equal widths.
    """
    ordered = _ordered_sides(reference, current)
    bins = F.least(
        F.lit(max_bins), F.greatest(F.lit(3), F.floor(F.sqrt(F.least("ref_total", "cur_total"))).cast("int"))
    )
    held = ordered.withColumn("_bins", bins)

    def edge(k: int) -> Column:
        place = (F.col("ref_total") - 1) * F.lit(k) / F.col("_bins")
        inside = F.col("_bins") >= k
        at = lambda index: F.max(
            F.when(inside & (F.col("ref_before") <= index) & (index < F.col("ref_before") + F.col("ref")), F.col("value"))
        )
        low, high = at(F.floor(place)), at(F.ceil(place))
        return low + F.max(F.when(inside, place - F.floor(place))) * (high - low)

    edges = held.groupBy("feature_name").agg(
        F.array_distinct(F.array_compact(F.array(*[edge(k) for k in range(max_bins + 1)]))).alias("_quantiles"),
        F.min(F.when(F.col("ref") > 0, F.col("value"))).alias("_low"),
        F.max(F.when(F.col("ref") > 0, F.col("value"))).alias("_high"),
        F.max("_bins").alias("_bins"),
        F.count_if(F.col("ref") > 0).alias("_ref_values"),
        F.count_if(F.col("cur") > 0).alias("_cur_values"),
        F.max("ref_total").alias("reference_samples"),
        F.max("cur_total").alias("current_samples"),
        F.min(F.when(F.col("cur") > 0, F.col("value"))).alias("_cur_low"),
    )
    # A constant reference gets the unit-wide range around its value.
    low = F.when(F.col("_low") == F.col("_high"), F.col("_low") - 0.5).otherwise(F.col("_low"))
    high = F.when(F.col("_low") == F.col("_high"), F.col("_high") + 0.5).otherwise(F.col("_high"))
    even = F.transform(F.sequence(F.lit(0), F.col("_bins")), lambda k: low + (high - low) * k / F.col("_bins"))
    edges = edges.withColumn("_edges", F.when(F.size("_quantiles") < 3, even).otherwise(F.col("_quantiles")))
    # One row of edges per feature: written once, read by the binning and the result, and small
    # enough to broadcast as the list of features is.
    edges = checkpointed(edges)
    placed = _sided(reference, current).join(F.broadcast(edges.select("feature_name", "_edges")), "feature_name")
    last = F.size("_edges") - 1
    index = F.size(F.filter("_edges", lambda e: e <= F.col("value"))) - 1
    index = F.when(F.col("value") == F.element_at("_edges", -1), last - 1).otherwise(index)
    binned = (
        placed.withColumn("_bin", index)
        .filter((F.col("_bin") >= 0) & (F.col("_bin") < last))
        .groupBy("feature_name", "_bin")
        .agg(F.count_if("is_reference").alias("_ref"), F.count_if(~F.col("is_reference")).alias("_cur"))
    )
    totals = binned.groupBy("feature_name").agg(F.sum("_ref").alias("_t_ref"), F.sum("_cur").alias("_t_cur"))
    share = lambda side: F.when(F.col(f"_{side}") > 0, F.col(f"_{side}") / F.col(f"_t_{side}")).otherwise(F.lit(EPSILON))
    psi = (
        binned.join(totals, "feature_name")
        .groupBy("feature_name")
        .agg(
            F.when((F.max("_t_ref") > 0) & (F.max("_t_cur") > 0), F.abs(F.sum(_psi_term(share("ref"), share("cur")))))
            .otherwise(0.0)
            .alias("_psi")
        )
    )
    few = (F.col("reference_samples") < min_rows) | (F.col("current_samples") < min_rows)
    constant = (F.col("_ref_values") == 1) & (F.col("_cur_values") == 1)
    return edges.join(psi, "feature_name", "left").select(
        "feature_name",
        F.when(few, 0.0)
        .when(constant, F.when(F.col("_low") == F.col("_cur_low"), 0.0).otherwise(1.0))
        .otherwise(F.coalesce("_psi", F.lit(0.0)))
        .alias("psi"),
        "reference_samples",
        "current_samples",
    )


def long_features(df: DataFrame, columns: list[str]) -> DataFrame:
    """Wide rows to (feature_name, value); all columns must share a type or cast to double."""
    kinds = {df.schema[c].dataType for c in columns}
    as_value = (lambda c: F.col(c)) if len(kinds) == 1 else (lambda c: F.col(c).cast("double"))
    pairs = F.array(*[F.struct(F.lit(c).alias("feature_name"), as_value(c).alias("value")) for c in columns])
    return df.select(F.explode(pairs).alias("p")).select("p.*")


def input_drift(
    reference: DataFrame,
    current: DataFrame,
    numeric: list[str],
    categorical: list[str] | None = None,
    method: str = "ks_test",
    threshold: float = 0.05,
    min_samples: int = 100,
    min_values: int = 10,
    exact_up_to: int = 10_000,
) -> DataFrame:
    """Drift of every feature with severity and recommended action. `exact_up_to` is that of kolmogorov_smirnov.

    `status` is `checked`, or says why a feature was not: the current data has fewer than `min_samples`
    rows, or a side fewer than `min_values` values. Such rows carry no drift figures.
    """
    if method not in ("ks_test", "psi"):
        raise ValueError(f"Unknown drift detection method: {method}")
    parts = []
    if numeric:
        sides = long_features(reference, numeric), long_features(current, numeric)
        parts.append(kolmogorov_smirnov(*sides, exact_up_to=exact_up_to) if method == "ks_test" else numeric_psi(*sides))
    if categorical:
        sides = long_features(reference, categorical), long_features(current, categorical)
        parts.append(categorical_chi_square(*sides).drop("degrees_of_freedom") if method == "ks_test" else categorical_psi(*sides))
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    if method == "psi":
        found = found.withColumnRenamed("psi", "statistic").withColumn(
            "p_value", F.when(F.col("statistic") < 0.1, 1.0).otherwise(0.0)
        )
        magnitude = F.least(F.col("statistic") / 2.0, F.lit(1.0))
    else:
        magnitude = F.col("statistic")
    size = current.agg(F.count(F.lit(1))).scalar()
    severity = F.when(F.col("drift_magnitude") < 0.1, "low").when(F.col("drift_magnitude") < 0.25, "medium").when(
        F.col("drift_magnitude") < 0.5, "high"
    ).otherwise("critical")
    action = F.when(
        F.col("drift_detected"),
        # The recommended actions.
        F.when(F.col("severity").isin("high", "critical"), "Immediate retraining recommended")
        .when(F.col("severity") == "medium", "Monitor closely, consider retraining")
        .otherwise("Continue monitoring"),
    )
    enough = (F.col("reference_samples") >= min_values) & (F.col("current_samples") >= min_values)
    status = F.when(size < min_samples, "too_few_rows").when(~F.coalesce(enough, F.lit(False)), "too_few_values").otherwise("checked")
    made = (
        found.withColumn("detection_method", F.lit(method))
        .withColumn("drift_magnitude", magnitude)
        .withColumn("drift_detected", F.col("p_value") < threshold)
        .withColumn("severity", severity)
        .withColumn("recommended_action", action)
        .withColumn("status", status)
    )
    figures = ["statistic", "p_value", "drift_magnitude", "drift_detected", "severity", "recommended_action"]
    return made.withColumns({name: F.when(F.col("status") == "checked", F.col(name)) for name in figures})
