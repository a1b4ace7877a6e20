"""Statistical comparison of groups: Spark sums up, closed forms finish."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from quillon.functions.ordering import ordered_counts, running_extreme
from quillon.functions.tails import (
    MOST_SUMS, SMALL_SIDE, chi_square_p, difference_posterior, normal_p, normal_point, rank_sum_p, student_p, student_quantile,
)


def two_group_moments(df: DataFrame, group: str, value: str, a, b) -> DataFrame:
    """One row: n, m (mean) and v (sample variance) for each of two groups."""
    cells = []
    for side, name in (("a", a), ("b", b)):
        own = F.when(F.col(group) == F.lit(name), F.col(value).cast("double"))
        cells += [F.count(own).alias(f"n_{side}"), F.avg(own).alias(f"m_{side}"), F.var_samp(own).alias(f"v_{side}")]
    return df.agg(*cells)


# An empty or single-valued group gives null results instead of an error.
over = F.try_divide


def welch_degrees() -> Column:
    sa, sb = over(F.col("v_a"), F.col("n_a")), over(F.col("v_b"), F.col("n_b"))
    return over((sa + sb) ** 2, over(sa**2, F.col("n_a") - 1) + over(sb**2, F.col("n_b") - 1))


def t_test(moments: DataFrame, equal_var: bool = True, alpha: float = 0.05) -> DataFrame:
    """Two-sample t (or Welch) on rows of n/m/v for sides a and b.

    The statistic is a - b; effect sizes and the interval are b - a, and the interval always
    uses the unpooled standard error.
    """
    n_a, n_b = F.col("n_a"), F.col("n_b")
    pooled = over((n_a - 1) * F.col("v_a") + (n_b - 1) * F.col("v_b"), n_a + n_b - 2)
    unpooled_error = F.sqrt(over(F.col("v_a"), n_a) + over(F.col("v_b"), n_b))
    if equal_var:
        degrees, error = (n_a + n_b - 2).cast("double"), F.sqrt(pooled * (over(F.lit(1.0), n_a) + over(F.lit(1.0), n_b)))
    else:
        degrees, error = welch_degrees(), unpooled_error
    difference = F.col("m_b") - F.col("m_a")
    cohens_d = F.try_divide(difference, F.sqrt(pooled))
    base = (
        moments.withColumn("statistic", F.try_divide(-difference, error))
        .withColumn("degrees_of_freedom", degrees)
        .withColumn("difference", difference)
        .withColumn("cohens_d", cohens_d)
        .withColumn("hedges_g", F.col("cohens_d") * (1 - 3 / (4 * (n_a + n_b) - 9)))
        .withColumn("_error", unpooled_error)
    )
    reach = student_quantile(F.lit(1 - alpha / 2), F.col("degrees_of_freedom")) * F.col("_error")
    return (
        base.withColumn("p_value", student_p("statistic", "degrees_of_freedom"))
        .withColumn("_reach", reach)
        .withColumn("ci_lower", F.col("difference") - F.col("_reach"))
        .withColumn("ci_upper", F.col("difference") + F.col("_reach"))
        .withColumn("is_significant", F.col("p_value") < alpha)
        .drop("_error", "_reach")
    )


def mann_whitney(df: DataFrame, group: str, value: str, a, b, alpha: float = 0.05) -> DataFrame:
    """U of group a, rank-biserial effect 1 - 2U/(n_a n_b), and the p-value.

    Without ties and with a side of at most SMALL_SIDE rows the p-value is exact, else it is the tie-corrected normal one;
    beyond MOST_SUMS possible sums even a small side gets that one.
    """
    rows = df.filter(F.col(group).isin(a, b)).select(F.col(group), F.col(value).cast("double").alias("_v"))
    ordered = ordered_counts(
        rows,
        [],
        "_v",
        {"n": F.count(F.lit(1)), "a": F.count_if(F.col(group) == F.lit(a)), "b": F.count_if(F.col(group) == F.lit(b))},
    )
    rank = F.col("n_before") + (F.col("n") + 1) / 2
    ties = F.col("n").cast("double")
    sums = ordered.agg(
        F.sum("a").alias("n_a"),
        F.sum("b").alias("n_b"),
        F.sum(F.col("a") * rank).alias("_rank_sum"),
        F.sum(ties**3 - ties).alias("_ties"),
    )
    n_a, n_b = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    n = n_a + n_b
    spread = F.sqrt(n_a * n_b / 12 * ((n + 1) - F.try_divide(F.col("_ties"), n * (n - 1))))
    u = F.col("u_statistic")
    exact = (F.least(n_a, n_b) <= SMALL_SIDE) & (F.least(n_a, n_b) > 0) & (F.col("_ties") == 0) & (n_a * n_b <= MOST_SUMS)
    return (
        sums.withColumn("u_statistic", F.col("_rank_sum") - n_a * (n_a + 1) / 2)
        .withColumn("effect_size", 1 - F.try_divide(2 * u, n_a * n_b))
        .withColumn("z", F.try_divide(F.greatest(u, n_a * n_b - u) - n_a * n_b / 2 - 0.5, spread))
        .withColumn("_limit", normal_p(F.when(F.col("z") > 0, F.col("z")).when(F.col("z").isNotNull(), F.lit(0.0))))
        .withColumn("_exact", rank_sum_p(F.when(exact, u), F.when(exact, n_a), F.when(exact, n_b)))
        .withColumn("p_value", F.coalesce("_exact", "_limit"))
        .withColumn("is_significant", F.col("p_value") < alpha)
        .drop("_rank_sum", "_ties", "_limit", "_exact")
    )


def proportion_test(counts: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Two-proportion z on rows of successes_a/b and trials_a/b; effect and interval are b - a."""
    p_a, p_b = over(F.col("successes_a"), F.col("trials_a")), over(F.col("successes_b"), F.col("trials_b"))
    pooled = over(F.col("successes_a") + F.col("successes_b"), F.col("trials_a") + F.col("trials_b"))
    inverse = over(F.lit(1.0), F.col("trials_a")) + over(F.lit(1.0), F.col("trials_b"))
    error = F.sqrt(pooled * (1 - pooled) * inverse)
    reach = F.lit(normal_point(1 - alpha / 2)) * error
    return (
        counts.withColumn("statistic", F.try_divide(p_a - p_b, error))
        .withColumn("effect_size", p_b - p_a)
        .withColumn("ci_lower", p_b - p_a - reach)
        .withColumn("ci_upper", p_b - p_a + reach)
        .withColumn("p_value", normal_p("statistic"))
        .withColumn("is_significant", F.col("p_value") < alpha)
    )


def chi_square(df: DataFrame, row: str, column: str, alpha: float = 0.05) -> DataFrame:
    """Independence of two columns, with Cramér's V; a 2x2 table gets the Yates correction.

    Only cells that occur are touched: empty cells are covered by
    `sum((O - E)^2 / E) = sum(O^2 / E) - n`.
    """
    present = df.filter(F.col(row).isNotNull() & F.col(column).isNotNull())
    cells = present.groupBy(row, column).agg(F.count(F.lit(1)).cast("double").alias("o"))
    rows = cells.groupBy(row).agg(F.sum("o").alias("r"))
    columns = cells.groupBy(column).agg(F.sum("o").alias("c"))
    total = cells.agg(F.sum("o")).scalar()
    placed = cells.join(rows, row).join(columns, column).withColumn("n", total)
    expected = F.col("r") * F.col("c") / F.col("n")
    sums = placed.agg(
        F.max("n").alias("n"),
        F.sum(F.col("o") ** 2 / expected).alias("_ratio"),
        F.max(F.abs(F.col("o") - expected)).alias("_gap"),
    )
    side = lambda df, total: df.agg(F.struct(F.count(F.lit(1)).alias("k"), F.sum(1 / F.col(total)).alias("inverse"))).scalar()
    sums = sums.withColumn("_r", side(rows, "r")).withColumn("_c", side(columns, "c"))
    corrected = F.greatest(F.col("_gap") - F.lit(0.5), F.lit(0.0)) ** 2 * F.col("n") * F.col("_r.inverse") * F.col("_c.inverse")
    degrees = (F.col("_r.k") - 1) * (F.col("_c.k") - 1)
    return (
        sums.withColumn("statistic", F.when(degrees == 1, corrected).otherwise(F.col("_ratio") - F.col("n")))
        .withColumn("degrees_of_freedom", degrees.cast("double"))
        .withColumn("cramers_v", F.sqrt(F.try_divide(F.col("statistic"), F.col("n") * (F.least("_r.k", "_c.k") - 1))))
        .withColumn("p_value", chi_square_p("statistic", "degrees_of_freedom"))
        .withColumn("is_significant", F.col("p_value") < alpha)
        .select("n", "statistic", "degrees_of_freedom", "cramers_v", "p_value", "is_significant")
    )


def sequential_test(moments: DataFrame, alpha: float = 0.05, beta: float = 0.2, effect_size: float = 0.5) -> DataFrame:
    """Boundaries and decision of the sequential ratio test; groups of unequal size raise."""
    theta = effect_size / 2**0.5
    n = F.col("n_a")
    error = F.sqrt(over(F.col("v_a") + F.col("v_b"), n))
    z = F.coalesce(F.try_divide(F.col("m_b") - F.col("m_a"), error), F.lit(0.0))
    upper = F.log(F.lit((1 - beta) / alpha)) / theta
    lower = F.log(F.lit(beta / (1 - alpha))) / theta
    checked = moments.withColumn(
        "sample_size",
        F.when(F.col("n_a") == F.col("n_b"), n).otherwise(
            F.raise_error(F.lit("Groups must have equal sample sizes for sequential test")).cast("long")
        ),
    )
    return (
        checked.withColumn("information", F.col("sample_size") * theta**2 / 2)
        .withColumn("test_statistic", z * F.sqrt("information"))
        .withColumn("upper_boundary", upper)
        .withColumn("lower_boundary", lower)
        .withColumn(
            "decision",
            F.when(F.col("test_statistic") >= upper, "reject_h0")
            .when(F.col("test_statistic") <= lower, "accept_h0")
            .otherwise("continue"),
        )
        .select("sample_size", "information", "test_statistic", "upper_boundary", "lower_boundary", "decision")
    )


CORRECTIONS = ("bonferroni", "holm", "benjamini_hochberg", "benjamini_yekutieli", "sidak")


def corrected_p(tests: DataFrame, family: str, method: str = "benjamini_hochberg", alpha: float = 0.05) -> DataFrame:
    """Multiple-comparison correction of `p_value` within each family of tests.

    Equal p-values get equal corrections, so the step methods work on distinct p-values with
    counts: Holm takes the running maximum of p * (m - smaller ones), the two false-discovery
    methods the running minimum from the top of p * m / (ones up to it).
    """
    if method not in CORRECTIONS:
        raise ValueError(f"unknown correction {method}")
    p = F.col("p_value")
    if method in ("bonferroni", "sidak"):
        sizes = tests.groupBy(F.col(family).alias("_family")).agg(F.count("p_value").alias("_m"))
        joined = tests.join(sizes, F.col(family).eqNullSafe(F.col("_family")), "left")
        corrected = p * F.col("_m") if method == "bonferroni" else 1 - F.pow(1 - p, F.col("_m"))
        result = joined.withColumn("corrected_p_value", F.least(corrected, F.lit(1.0))).drop("_family", "_m")
    else:
        m = F.col("n_total")
        if method == "holm":
            raw = p * (m - F.col("n_before"))
        else:
            factor = F.lit(1.0)
            if method == "benjamini_yekutieli":
                factor = harmonic(m)
            raw = p * m / (F.col("n_before") + F.col("n")) * factor
        ordered = ordered_counts(tests, [family], "p_value", keep_range=True).withColumn("_raw", raw)
        stepped = running_extreme(ordered, [family], "p_value", "_raw", rising=method == "holm").select(
            F.col(family).alias("_family"), F.col("p_value").alias("_p"), "_raw"
        )
        on = F.col(family).eqNullSafe(F.col("_family")) & (p == F.col("_p"))
        result = (
            tests.join(stepped, on, "left")
            .withColumn("corrected_p_value", F.least("_raw", F.lit(1.0)))
            .drop("_family", "_p", "_raw")
        )
    return result.withColumn("reject_null", F.col("corrected_p_value") <= alpha)


def harmonic(m: Column) -> Column:
    """1 + 1/2 + ... + 1/m as the digamma function at m + 1: its series ten terms further on, less those terms."""
    shift = 10
    x = m.cast("double") + (shift + 1)
    y = 1 / (x * x)
    series = F.log(x) - 1 / (2 * x) - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))
    return series + 0.5772156649015329 - sum((1 / (m + k) for k in range(1, shift + 1)), F.lit(0.0))


def bayesian(
    moments: DataFrame,
    prior_mean: float = 0.0,
    prior_std: float = 1.0,
    rope: tuple[float, float] | None = None,
) -> DataFrame:
    """Posterior of the difference of means from n/m/v: chance that b is better, losses, interval, ROPE.

    The means have a normal prior and the unknown deviations a half-normal one of scale 1. Both deviations are integrated
    out by quadrature (see deviation_nodes), so nothing is sampled. A side with fewer than two rows gives null.
    """
    low, high = rope or (0.0, 0.0)
    names = ["probability_b_better", "expected_loss_a", "expected_loss_b", "ci_lower", "ci_upper", "rope_probability"]

    @F.pandas_udf(", ".join(f"{name} double" for name in names))
    def posterior(*columns: pd.Series) -> pd.DataFrame:
        found = []
        for row in zip(*columns):
            known = not any(pd.isna(x) for x in row)
            found.append(difference_posterior(row[:3], row[3:], (prior_mean, prior_std), (low, high)) if known else (None,) * len(names))
        return pd.DataFrame(found, columns=names, dtype="float64")

    sides = [F.col(f"{what}_{side}").cast("double") for side in ("a", "b") for what in ("n", "m", "v")]
    found = moments.withColumn("_p", posterior(*sides)).select(*moments.columns, "_p.*")
    found = found.withColumn("probability_a_better", 1 - F.col("probability_b_better"))
    return found if rope is not None else found.drop("rope_probability")
