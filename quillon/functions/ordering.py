"""Exact ranks and quantiles without a single-task sort.

Rows are first collapsed to distinct values with counts, so a hot value is one row. Each value
then falls into one of as many value ranges as there are shuffle partitions. They come from a sketch and only decide
the balance of the work, never the answer. Running counts are taken inside a range and shifted
by the totals of the ranges below. No range depends on the key, so a key that owns a third of
the rows is spread over all ranges.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

LEAST_RANGES = 16


def range_bounds(df: DataFrame, value: str) -> list[float]:
    """Ascending cut points for `value`, one fewer than there are ranges."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    ranges = max(partitions, LEAST_RANGES)
    shares = [at / ranges for at in range(1, ranges)]
    row = df.agg(F.percentile_approx(F.col(value).cast("double"), shares, max(2000, 8 * ranges)).alias("cuts")).first()
    return sorted(set(row["cuts"] or []))


def range_of(value: Column, bounds: list[float]) -> Column:
    """How many cut points lie below `value`, by a coarse then a fine look-up."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds)) + 1
    every = F.array(*[F.lit(float(bound)) for bound in bounds])
    coarse = F.array(*[F.lit(float(bound)) for bound in bounds[step - 1 :: step]] or [F.lit(float("inf"))])
    point = value.cast("double")
    block = F.size(F.filter(coarse, lambda bound: bound < point)) * step
    inside = F.slice(every, block + 1, F.lit(step))
    return block + F.size(F.filter(inside, lambda bound: bound < point))


def ordered_counts(
    df: DataFrame,
    keys: list[str],
    value: str,
    counts: dict[str, Column] | None = None,
    keep_range: bool = False,
) -> DataFrame:
    """Distinct non-null values per key, with running counts.

    For each entry of `counts` (default `n`, the row count) the result holds `<name>`,
    `<name>_before` (total over smaller values) and `<name>_total` (total over the key).
    With `keep_range` the value range of each row stays, as `_range`.
    """
    counts = counts or {"n": F.count(F.lit(1))}
    present = df.filter(F.col(value).isNotNull())
    bounds = range_bounds(present, value)
    distinct = (
        present.groupBy(*keys, value)
        .agg(*[expr.alias(name) for name, expr in counts.items()])
        .withColumn("_range", range_of(F.col(value), bounds))
    )
    per_range = distinct.groupBy(*keys, "_range").agg(
        *[F.sum(name).alias(f"_{name}") for name in counts]
    )
    whole = Window.partitionBy(*(keys or [F.lit(0)]))
    below = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = per_range.select(
        *[F.col(key).alias(f"_k_{key}") for key in keys],
        F.col("_range").alias("_k_range"),
        *[F.coalesce(F.sum(f"_{name}").over(below), F.lit(0)).alias(f"_{name}_shift") for name in counts],
        *[F.sum(f"_{name}").over(whole).alias(f"{name}_total") for name in counts],
    )
    within = (
        Window.partitionBy(*keys, "_range")
        .orderBy(value)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    running = distinct.select(
        "*",
        *[F.coalesce(F.sum(name).over(within), F.lit(0)).alias(f"_{name}_run") for name in counts],
    )
    on = F.col("_range") == F.col("_k_range")
    for key in keys:
        on = on & F.col(key).eqNullSafe(F.col(f"_k_{key}"))
    return running.join(shifts, on).select(
        *keys,
        value,
        *[F.col(name) for name in counts],
        *[(F.col(f"_{name}_run") + F.col(f"_{name}_shift")).alias(f"{name}_before") for name in counts],
        *[F.col(f"{name}_total") for name in counts],
        *(["_range"] if keep_range else []),
    )


def running_extreme(ordered: DataFrame, keys: list[str], value: str, column: str, rising: bool) -> DataFrame:
    """Replace `column` by its running maximum (rising), or its running minimum from the top.

    `ordered` comes from ordered_counts with keep_range; ranges are combined as the counts are.
    """
    best = F.max if rising else F.min
    pick = F.greatest if rising else F.least
    turn = (lambda c: F.col(c).asc()) if rising else (lambda c: F.col(c).desc())
    whole = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(turn("_range"))
    per_range = ordered.groupBy(*keys, "_range").agg(best(column).alias("_best"))
    earlier = per_range.select(
        *[F.col(key).alias(f"_k_{key}") for key in keys],
        F.col("_range").alias("_k_range"),
        best("_best").over(whole.rowsBetween(Window.unboundedPreceding, -1)).alias("_earlier"),
    )
    within = Window.partitionBy(*keys, "_range").orderBy(turn(value)).rowsBetween(Window.unboundedPreceding, 0)
    on = F.col("_range") == F.col("_k_range")
    for key in keys:
        on = on & F.col(key).eqNullSafe(F.col(f"_k_{key}"))
    rows = ordered.withColumn(column, best(column).over(within)).join(earlier, on)
    return rows.select(*[pick(column, "_earlier").alias(column) if c == column else F.col(c) for c in ordered.columns])


def value_at(value: str, index: Column) -> Column:
    """Aggregate: the value at a 0-based position of the sorted rows of an ordered_counts group."""
    here = (F.col("n_before") <= index) & (index < F.col("n_before") + F.col("n"))
    return F.max(F.when(here, F.col(value)))


@dataclass(frozen=True)
class Pick:
    """An aggregate over the sorted rows of a group, and the 0-based positions of the rows that it reads."""

    column: Column
    positions: tuple[Column, ...]


def at_position(value: str, index: Column) -> Pick:
    """The row at a position, which may depend on `n_total`."""
    return Pick(value_at(value, index), (index,))


def linear_quantile(value: str, share: float) -> Pick:
    """Quantile with linear interpolation between the two neighbouring rows."""
    position = (F.col("n_total") - 1) * F.lit(float(share))
    low, high = F.floor(position), F.ceil(position)
    weight = F.max(position - F.floor(position))
    return Pick(value_at(value, low) + weight * (value_at(value, high) - value_at(value, low)), (low, high))


def indexed_quantile(value: str, percent: float) -> Pick:
    """The row at `min(int(n * percent / 100), n - 1)` of the sorted rows."""
    index = F.floor(F.col("n_total") * F.lit(float(percent)) / F.lit(100.0))
    return at_position(value, F.least(index, F.col("n_total") - 1))


#: Buckets of values within a factor of two.
PER_OCTAVE = 64


def bucket_of(value: Column) -> Column:
    """A whole number that never falls while the value rises: sign, and the logarithm in steps of 1 / PER_OCTAVE.

    It needs no look at the data, and gives few buckets however values spread. NaN comes last, as in sorting.
    """
    x = value.cast("double")
    size = F.floor(F.least(F.log2(F.abs(x)) * PER_OCTAVE, F.lit(1e6))).cast("long") + 100_000
    return F.when(F.isnan(x), F.lit(1 << 40)).when(x == 0, F.lit(0)).when(x > 0, size).otherwise(-size).cast("long")


def holding(positions: list[Column], before: str, n: str) -> Column:
    """Whether one of the positions falls on the n rows after the first `before`."""
    return reduce(lambda a, b: a | b, [(p >= F.col(before)) & (p < F.col(before) + F.col(n)) for p in positions])


#: Parts of equal width into which a bucket's values are dealt.
PARTS = 256


def _matching(names: dict[str, str]) -> Column:
    """Equality of columns, null equal to null."""
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(k)) for c, k in names.items()])


def quantiles(df: DataFrame, keys: list[str], value: str, picks: dict[str, Pick]) -> DataFrame:
    """One row per key with the requested picks.

    Two scans. The first counts rows by bucket, which combines before the shuffle; the running counts of a key tell
    which buckets hold a wanted position. The second reads only the values of those buckets and deals each bucket into
    parts of equal width; only parts that hold a wanted position are ranked, so neither a hot key nor values that
    all lie close together are sorted in one task.
    """
    positions = [p for pick in picks.values() for p in pick.positions]
    rows = df.where(F.col(value).isNotNull()).select(*keys, value, bucket_of(F.col(value)).alias("_range"))
    number = F.col(value).cast("double")
    counted = rows.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"), F.min(number).alias("_low"), F.max(number).alias("_high"))
    whole = Window.partitionBy(*(keys or [F.lit(0)]))
    below = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("_before", F.coalesce(F.sum("_n").over(below), F.lit(0))).withColumn("n_total", F.sum("_n").over(whole))
    held = {c: f"_k{at}" for at, c in enumerate([*keys, "_range"])}
    wanted = placed.where(holding(positions, "_before", "_n"))
    wanted = wanted.select(*[F.col(c).alias(k) for c, k in held.items()], "_before", "n_total", "_low", "_high")
    part = F.when(F.col("_high") > F.col("_low"), F.floor((number - F.col("_low")) / (F.col("_high") - F.col("_low")) * PARTS)).otherwise(0)
    named = [*keys, "_range", "_part"]
    values = rows.join(wanted, _matching(held)).withColumn("_part", part).groupBy(*named, value, "_before", "n_total").agg(F.count(F.lit(1)).alias("n"))

    earlier = Window.partitionBy(*keys, "_range").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = values.groupBy(*named, "_before", "n_total").agg(F.sum("n").alias("_n"))
    parts = parts.withColumn("_shift", F.col("_before") + F.coalesce(F.sum("_n").over(earlier), F.lit(0))).where(holding(positions, "_shift", "_n"))
    held = {c: f"_k{at}" for at, c in enumerate(named)}
    found = values.join(parts.select(*[F.col(c).alias(k) for c, k in held.items()], "_shift"), _matching(held))
    within = Window.partitionBy(*named).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ordered = found.withColumn("n_before", F.col("_shift") + F.coalesce(F.sum("n").over(within), F.lit(0)))
    return ordered.groupBy(*keys).agg(*[pick.column.alias(name) for name, pick in picks.items()])
