"""Time windows per key, the same call for batch and for streams.

A batch over sliding or session windows first collapses rows into narrow time slices per key, so
the shuffle carries slices instead of events and a hot key costs at most one row per slice.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillon.functions.ordering import Pick, bucket_of, holding, indexed_quantile, quantiles
from quillon.functions.paths import nested, numeric


@dataclass(frozen=True)
class Tumbling:
    size_ms: int


@dataclass(frozen=True)
class Sliding:
    size_ms: int
    slide_ms: int | None = None

    @property
    def step_ms(self) -> int:
        return self.slide_ms or self.size_ms // 2


@dataclass(frozen=True)
class Session:
    gap_ms: int = 300_000


@dataclass(frozen=True)
class Everything:
    """One window over all time."""


@dataclass(frozen=True)
class Agg:
    """`kind` is count, sum, avg, min, max, distinct_count, percentile, first or last."""

    kind: str
    field: str | None = None
    percentile: float = 50.0
    name: str | None = None

    @property
    def label(self) -> str:
        if self.name:
            return self.name
        return self.kind if self.field is None else f"{self.kind}_{self.field.replace('.', '_')}"


SPLITTABLE = {"count", "sum", "avg", "min", "max", "first", "last"}
KINDS = SPLITTABLE | {"distinct_count", "percentile"}


def _prepared(df: DataFrame, key: str, aggs: list[Agg], time: str, tie: str) -> DataFrame:
    """Only the needed columns: key, time in microseconds, tie-break, and each field."""
    for agg in aggs:
        if agg.kind not in KINDS:
            raise ValueError(f"Unknown aggregation type: {agg.kind}")
    fields = []
    for at, agg in enumerate(aggs):
        if agg.field is not None:
            read = numeric if agg.kind in {"sum", "avg", "min", "max", "percentile"} else nested
            fields.append(read(df, agg.field).alias(f"_f{at}"))
    return df.select(
        F.col(key),
        F.col(time),
        F.unix_micros(F.col(time).cast("timestamp")).alias("_us"),
        F.col(tie).alias("_tie"),
        *fields,
    )


def _value(at: int) -> Column:
    return F.col(f"_f{at}")


def _partials(aggs: list[Agg]) -> list[Column]:
    """What one slice keeps for each aggregation."""
    kept = []
    for at, agg in enumerate(aggs):
        place = F.when(_value(at).isNotNull(), F.struct("_us", "_tie", _value(at).alias("v"))) if agg.field else None
        match agg.kind:
            case "count":
                kept.append(F.count(F.lit(1)).alias(f"_p{at}"))
            case "sum":
                kept.append(F.sum(_value(at)).alias(f"_p{at}"))
            case "avg":
                kept += [F.sum(_value(at)).alias(f"_p{at}"), F.count(_value(at)).alias(f"_q{at}")]
            case "min":
                kept.append(F.min(_value(at)).alias(f"_p{at}"))
            case "max":
                kept.append(F.max(_value(at)).alias(f"_p{at}"))
            case "first":
                kept.append(F.min(place).alias(f"_p{at}"))
            case "last":
                kept.append(F.max(place).alias(f"_p{at}"))
    return kept


def _merges(aggs: list[Agg]) -> dict[str, str]:
    """How two slices' parts of each aggregation become one: sum, min or max."""
    how = {"min": "min", "first": "min", "max": "max", "last": "max"}
    merges = {}
    for at, agg in enumerate(aggs):
        merges[f"_p{at}"] = how.get(agg.kind, "sum")
        if agg.kind == "avg":
            merges[f"_q{at}"] = "sum"
    return merges


MERGED = {"sum": F.sum, "min": F.min, "max": F.max}


def _both(how: str, a: Column, b: Column) -> Column:
    """Two parts as one; null is the part of nothing."""
    if how == "sum":
        return F.coalesce(a + b, a, b)
    return F.least(a, b) if how == "min" else F.greatest(a, b)


def _finished(aggs: list[Agg]) -> list[Column]:
    """The result of each aggregation from the merged parts of a window."""
    results = []
    for at, agg in enumerate(aggs):
        part = F.col(f"_p{at}")
        match agg.kind:
            case "sum":
                part = F.coalesce(part, F.lit(0.0))
            case "avg":
                part = F.coalesce(F.try_divide(part, F.col(f"_q{at}")), F.lit(0.0))
            case "first" | "last":
                part = part.getField("v")
        results.append(part.alias(agg.label))
    return results


def _direct(aggs: list[Agg], streaming: bool) -> list[Column]:
    """Aggregations over raw rows. Streams get the approximate distinct count and percentile."""
    results = []
    for at, agg in enumerate(aggs):
        place = F.when(_value(at).isNotNull(), F.struct("_us", "_tie", _value(at).alias("v"))) if agg.field else None
        match agg.kind:
            case "count":
                result = F.count(F.lit(1))
            case "sum":
                result = F.coalesce(F.sum(_value(at)), F.lit(0.0))
            case "avg":
                result = F.coalesce(F.avg(_value(at)), F.lit(0.0))
            case "min":
                result = F.min(_value(at))
            case "max":
                result = F.max(_value(at))
            case "first":
                result = F.min(place).getField("v")
            case "last":
                result = F.max(place).getField("v")
            case "distinct_count":
                result = F.approx_count_distinct(_value(at)) if streaming else F.count_distinct(_value(at))
            case "percentile":
                result = F.percentile_approx(_value(at), agg.percentile / 100.0)
        results.append(result.alias(agg.label))
    return results


def _millis(ms: int) -> str:
    return f"{ms} milliseconds"


def _bounds(kind, time: str) -> list[Column]:
    """Grouping column for Spark's own window functions."""
    if isinstance(kind, Tumbling):
        return [F.window(time, _millis(kind.size_ms)).alias("_w")]
    if isinstance(kind, Sliding):
        return [F.window(time, _millis(kind.size_ms), _millis(kind.step_ms)).alias("_w")]
    if isinstance(kind, Session):
        return [F.session_window(time, _millis(kind.gap_ms)).alias("_w")]
    return []


def window_aggregate(
    df: DataFrame,
    key: str,
    window,
    aggs: list[Agg],
    time: str = "ts",
    tie: str = "event_id",
    lateness: str | None = "10 seconds",
) -> DataFrame:
    """One row per key and window: key, window_start, window_end and the aggregations.

    Windows are `[start, end)` aligned to the epoch; a session closes when the next event comes
    more than the gap after the last one. `tie` orders events of equal time for first and last.
    A stream with a lateness computes distinct counts and percentiles exactly, by its own state (see
    quillon.streaming.exact); without one, or over all time, it gives Spark's approximations.
    """
    if df.isStreaming and lateness and not isinstance(window, Everything) and any(agg.kind not in SPLITTABLE for agg in aggs):
        from quillon.streaming.exact import exact_windows

        return exact_windows(df, key, window, aggs, time, tie, lateness)
    rows = _prepared(df, key, aggs, time, tie)
    if df.isStreaming:
        if lateness:
            rows = rows.withWatermark(time, lateness)
        result = rows.groupBy(key, *_bounds(window, time)).agg(*_direct(aggs, True))
        return _open_window(result, key, aggs)
    if isinstance(window, Everything):
        return _whole(rows, key, aggs)
    kind = df.schema[time].dataType.simpleString()
    result = _sliced(rows, key, window, aggs)
    if any(agg.kind not in SPLITTABLE for agg in aggs):
        result = _with_exact(rows, result, key, window, aggs)
    return result.select(
        key,
        F.timestamp_micros("_start").cast(kind).alias("window_start"),
        F.timestamp_micros("_end").cast(kind).alias("window_end"),
        *[agg.label for agg in aggs],
    )


def _open_window(result: DataFrame, key: str, aggs: list[Agg]) -> DataFrame:
    if "_w" not in result.columns:
        return result
    return result.select(
        key,
        F.col("_w.start").alias("window_start"),
        F.col("_w.end").alias("window_end"),
        *[agg.label for agg in aggs],
    )


def _whole(rows: DataFrame, key: str, aggs: list[Agg]) -> DataFrame:
    simple = [agg for agg in aggs if agg.kind != "percentile"]
    kept = [column for column, agg in zip(_direct(aggs, False), aggs) if agg in simple]
    result = rows.groupBy(key).agg(*(kept or [F.count(F.lit(1)).alias("_rows")]))
    return _with_percentiles(result, rows, [key], aggs).select(key, *[agg.label for agg in aggs])


def _with_percentiles(result: DataFrame, rows: DataFrame, keys: list[str], aggs: list[Agg]) -> DataFrame:
    """Join the percentiles to the other aggregations; those of one field share one ordering."""
    by_field: dict[str, list[tuple[int, Agg]]] = {}
    for at, agg in enumerate(aggs):
        if agg.kind == "percentile":
            by_field.setdefault(agg.field, []).append((at, agg))
    for wanted in by_field.values():
        value = f"_f{wanted[0][0]}"
        picks = {agg.label: indexed_quantile(value, agg.percentile) for _, agg in wanted}
        result = _beside(result, quantiles(rows, keys, value, picks), keys)
    return result


def _beside(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on possibly null keys."""
    renamed = right.select(*[F.col(k).alias(f"_j_{k}") if k in keys else F.col(k) for k in right.columns])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_j_{k}")) for k in keys])
    return left.join(renamed, on, "left").drop(*[f"_j_{k}" for k in keys])


#: Overlapping windows per moment up to which a slice is copied to each of its windows, instead of scanned in blocks.
FEW = 8


def _sliced(rows: DataFrame, key: str, window, aggs: list[Agg]) -> DataFrame:
    """Key, _start, _end and every splittable aggregation, by way of time slices."""
    split = [agg if agg.kind in SPLITTABLE else Agg("count", name=f"_skip_{agg.label}") for agg in aggs]
    merges = _merges(split)
    if isinstance(window, Session):
        slices = _session_map(rows, key, window, _partials(split))
        merged = slices.groupBy(key, "_start").agg(
            (F.max("_high") + window.gap_ms * 1000).alias("_end"), *[MERGED[how](part).alias(part) for part, how in merges.items()]
        )
        return merged.select(key, "_start", "_end", *_finished(split))
    size, width = window.size_ms * 1000, _width(window)
    slices = rows.groupBy(key, F.floor(F.col("_us") / width).alias("_slice")).agg(*_partials(split))
    if isinstance(window, Sliding):
        n, step = size // width, window.step_ms * 1000 // width
        if n <= FEW * step:
            placed = slices.withColumn("_slice", F.explode(_starts(F.col("_slice"), n, step)))
            slices = placed.groupBy(key, "_slice").agg(*[MERGED[how](part).alias(part) for part, how in merges.items()])
        else:
            slices = _slid(slices, [key], n, step, merges)
    start = F.col("_slice") * width
    return slices.select(key, start.alias("_start"), (start + size).alias("_end"), *_finished(split))


def _width(window) -> int:
    """Microseconds of a slice: the widest that both the size and the step are multiples of."""
    size = window.size_ms * 1000
    return size if isinstance(window, Tumbling) else math.gcd(size, window.step_ms * 1000)


def _starts(point: Column, size: int, step: int) -> Column:
    """Starts of all windows of `size` every `step` that hold a moment, or a slice, all counted in one unit."""
    last = F.floor(point / step).cast("long") * step
    first = (F.floor((point - size) / step).cast("long") + 1) * step
    return F.when(first <= last, F.sequence(first, last, F.lit(step).cast("long")))  # a slide over the size leaves gaps


def _opened(slices: DataFrame, keys: list[str], n: int, step: int, block: Column) -> DataFrame:
    """(keys, _at, _foreign): the starts of the windows of n slices that a slice is the first in.

    A slice is looked at beside those of its block of n alone, so its starts in the block before are marked as foreign:
    they count only if no slice of that block comes at or after them.
    """
    in_block = Window.partitionBy(*keys, "_block").orderBy("_slice")
    looked = slices.select(*keys, "_slice", block.alias("_block")).withColumn("_last", F.lag("_slice").over(in_block))
    low = F.greatest(F.col("_last") + 1, F.col("_slice") - (n - 1))
    first, last = (F.ceil(low / step) * step).cast("long"), (F.floor(F.col("_slice") / step) * step).cast("long")
    starts = F.explode(F.when(first <= last, F.sequence(first, last, F.lit(step).cast("long"))))
    found = looked.select(*keys, "_block", starts.alias("_at"))
    return found.select(*keys, "_at", (F.floor(F.col("_at") / n) < F.col("_block")).alias("_foreign"))


def _slid(slices: DataFrame, keys: list[str], n: int, step: int, merges: dict[str, str]) -> DataFrame:
    """(keys, _slice, parts) of every window of n slices that holds one, `_slice` its start, a multiple of `step`.

    Slices fall into blocks of n. A window is the end of one block and the beginning of the next, so two running scans,
    back from each block's end and on from its beginning, give every window by one merge: a slice is read twice however
    many windows it is in. Both go by key and block, so a hot key is spread over its blocks.
    """
    block = F.floor(F.col("_slice") / n)
    parts = list(merges)
    nothing = [F.lit(None).cast(slices.schema[part].dataType).alias(part) for part in parts]
    own = slices.select(*keys, block.alias("_block"), F.col("_slice").alias("_at"), F.lit(0).alias("_asks"), *parts)
    starts = _opened(slices, keys, n, step, block)

    asked = starts.select(*keys, F.floor(F.col("_at") / n).alias("_block"), "_at", F.lit(1).alias("_asks"), *nothing, "_foreign")
    back = Window.partitionBy(*keys, "_block").orderBy(F.desc("_at"), "_asks").rowsBetween(Window.unboundedPreceding, 0)
    ends = own.withColumn("_foreign", F.lit(False)).unionByName(asked)
    ends = ends.select(
        *keys, "_at", "_asks", "_foreign", F.sum(1 - F.col("_asks")).over(back).alias("_seen"), *[MERGED[how](part).over(back).alias(f"_e{part}") for part, how in merges.items()]
    ).where("_asks = 1 AND NOT (_foreign AND _seen > 0)")

    # A window that starts with its block is all of it, and has no beginning of another.
    last = F.col("_at") + (n - 1)
    carried = [f"_e{part}" for part in parts]
    asked = ends.select(*keys, F.floor(last / n).alias("_block"), last.alias("_at"), F.lit(1).alias("_asks"), *nothing, *carried)
    on = Window.partitionBy(*keys, "_block").orderBy("_at", "_asks").rowsBetween(Window.unboundedPreceding, 0)
    empty = [F.lit(None).cast(slices.schema[part].dataType).alias(f"_e{part}") for part in parts]
    begins = own.select("*", *empty).unionByName(asked)
    begins = begins.select(*keys, "_at", "_asks", *carried, *[MERGED[how](part).over(on).alias(part) for part, how in merges.items()]).where("_asks = 1")
    start = F.col("_at") - (n - 1)
    merged = [F.when(start % n == 0, F.col(f"_e{part}")).otherwise(_both(how, F.col(f"_e{part}"), F.col(part))).alias(part) for part, how in merges.items()]
    return begins.select(*keys, start.alias("_slice"), *merged)


#: Slices of one key that are put in order together when sessions are found.
RANGE = 1024


def _session_map(rows: DataFrame, key: str, window: Session, partials: list[Column]) -> DataFrame:
    """Slices one gap wide, with `_start` of their session: two events of one slice always share one.

    Sessions are first found inside ranges of RANGE slices. Only the borders of the ranges, one row each, are then put
    in order by key: a range whose first session goes on from before takes over its start.
    """
    gap = window.gap_ms * 1000
    slices = rows.groupBy(key, F.floor(F.col("_us") / gap).alias("_slice")).agg(
        F.min("_us").alias("_low"), F.max("_us").alias("_high"), *partials
    )
    slices = slices.withColumn("_range", F.floor(F.col("_slice") / RANGE))
    inside = Window.partitionBy(key, "_range").orderBy("_slice")
    fresh = F.col("_low") - F.lag("_high").over(inside) > gap
    slices = slices.withColumn("_own", F.when(F.coalesce(fresh, F.lit(True)), F.col("_low")))
    slices = slices.withColumn("_own", F.max("_own").over(inside.rowsBetween(Window.unboundedPreceding, 0)))

    borders = slices.groupBy(key, "_range").agg(
        F.min("_own").alias("_first"), F.max("_own").alias("_last"), F.max("_high").alias("_top")
    )
    in_time = Window.partitionBy(key).orderBy("_range")
    opens = F.coalesce(F.col("_first") - F.lag("_top").over(in_time) > gap, F.lit(True))
    borders = borders.withColumn("_opens", opens)
    # The start of the session at a range's end, unless the range is inside one session that began before it.
    known = F.when(F.col("_last") > F.col("_first"), F.col("_last")).when(F.col("_opens"), F.col("_first"))
    before = F.last(known, ignorenulls=True).over(in_time.rowsBetween(Window.unboundedPreceding, -1))
    borders = borders.select(
        F.col(key).alias("_j_key"), F.col("_range").alias("_j_range"), "_first", F.when(F.col("_opens"), F.col("_first")).otherwise(before).alias("_begin")
    )
    on = F.col(key).eqNullSafe(F.col("_j_key")) & (F.col("_range") == F.col("_j_range"))
    start = F.when(F.col("_own") == F.col("_first"), F.col("_begin")).otherwise(F.col("_own"))
    return slices.join(borders, on).select(*slices.columns, start.alias("_start")).drop("_range", "_own")


def _with_exact(rows: DataFrame, result: DataFrame, key: str, window, aggs: list[Agg]) -> DataFrame:
    """Add distinct counts and percentiles next to the sliced aggregations."""
    exact = [(at, agg) for at, agg in enumerate(aggs) if agg.kind not in SPLITTABLE]
    if isinstance(window, Sliding):
        for at, agg in exact:
            if agg.kind == "distinct_count":
                result = _beside(result, _sliding_distinct(rows, key, window, at, agg.label), [key, "_start"])
                result = result.withColumn(agg.label, F.coalesce(F.col(agg.label), F.lit(0).cast("long")))
        for field in dict.fromkeys(agg.field for _, agg in exact if agg.kind == "percentile"):
            wanted = [(at, agg) for at, agg in exact if agg.kind == "percentile" and agg.field == field]
            picks = {agg.label: indexed_quantile("_value", agg.percentile) for _, agg in wanted}
            result = _beside(result, _sliding_quantiles(rows, key, window, wanted[0][0], picks), [key, "_start"])
        return result
    assigned = _assigned(rows, key, window)
    distinct = [column for column, agg in zip(_direct(aggs, False), aggs) if agg.kind == "distinct_count"]
    if distinct:
        result = _beside(result, assigned.groupBy(key, "_start").agg(*distinct), [key, "_start"])
    return _with_percentiles(result, assigned, [key, "_start"], aggs)


def _assigned(rows: DataFrame, key: str, window) -> DataFrame:
    """Every row with the start of its one window."""
    if isinstance(window, Session):
        spans = _session_map(rows, key, window, [])
        gap = window.gap_ms * 1000
        return _beside(rows.withColumn("_slice", F.floor(F.col("_us") / gap)), spans.select(key, "_slice", "_start"), [key, "_slice"])
    size = window.size_ms * 1000
    return rows.withColumn("_start", F.floor(F.col("_us") / size) * size)


def _sliding_distinct(rows: DataFrame, key: str, window: Sliding, at: int, label: str) -> DataFrame:
    """(key, _start, label): distinct values of field `at` per window.

    A value's slice opens to it the windows that start after the one before could have, up to the slice itself: one more
    at the first of them, one less after the last. The running sum of these steps is the count at every start, so a
    value meets no window. Sums run inside blocks and are shifted by the totals of earlier blocks.
    """
    width = _width(window)
    n, step = window.size_ms * 1000 // width, window.step_ms * 1000 // width
    value = F.col(f"_f{at}")
    seen = rows.where(value.isNotNull()).select(key, value.alias("_value"), F.floor(F.col("_us") / width).alias("_slice")).distinct()
    if n <= FEW * step:
        placed = seen.select(key, "_value", F.explode(_starts(F.col("_slice"), n, step)).alias("_at"))
        return placed.groupBy(key, (F.col("_at") * width).alias("_start")).agg(F.count_distinct("_value").alias(label))
    by_value = Window.partitionBy(key, "_value").orderBy("_slice")
    opened = seen.withColumn("_low", F.greatest(F.lag("_slice").over(by_value) + 1, F.col("_slice") - (n - 1)))
    steps = F.array(F.struct(F.col("_low").alias("_at"), F.lit(1).alias("_step")), F.struct((F.col("_slice") + 1).alias("_at"), F.lit(-1).alias("_step")))
    steps = opened.select(key, F.inline(steps)).groupBy(key, "_at").agg(F.sum("_step").alias("_step"))
    starts = _windows_of(seen, key, n, step)

    blocked = lambda df: df.withColumn("_block", F.floor(F.col("_at") / n))
    asked = starts.select(key, "_at", F.lit(0).cast("long").alias("_step"), F.lit(1).alias("_asks"))
    within = Window.partitionBy(key, "_block").orderBy("_at", "_asks").rowsBetween(Window.unboundedPreceding, 0)
    both = blocked(steps.withColumn("_asks", F.lit(0)).unionByName(asked)).withColumn("_sum", F.sum("_step").over(within))
    earlier = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = blocked(steps).groupBy(key, "_block").agg(F.sum("_step").alias("_step"))
    # A block of starts alone takes the total of the last block with steps: those sums are zero or run on.
    blocks = totals.unionByName(blocked(starts).select(key, "_block").distinct().withColumn("_step", F.lit(0).cast("long")))
    shifts = blocks.groupBy(key, "_block").agg(F.sum("_step").alias("_step")).withColumn("_shift", F.coalesce(F.sum("_step").over(earlier), F.lit(0)))
    found = _beside(both.where("_asks = 1"), shifts.select(key, "_block", "_shift"), [key, "_block"])
    return found.select(key, (F.col("_at") * width).alias("_start"), (F.col("_sum") + F.col("_shift")).alias(label))


def _windows_of(slices: DataFrame, key: str, n: int, step: int) -> DataFrame:
    """(key, _at): the starts of all windows of n slices that hold one of `slices`."""
    own = slices.select(key, "_slice").distinct().withColumn("_p0", F.lit(1).cast("long"))
    return _slid(own, [key], n, step, {"_p0": "sum"}).select(key, F.col("_slice").alias("_at"))


def _sliding_quantiles(rows: DataFrame, key: str, window: Sliding, at: int, picks: dict[str, Pick]) -> DataFrame:
    """(key, _start, picks) over field `at` per window, from one histogram of (key, slice, value).

    Counts by bucket of values slide over the slices; their running sums tell which bucket of a window holds a wanted
    position. Only the values of that bucket, from the window's slices, are counted and ranked for it.
    """
    width = _width(window)
    n, step = window.size_ms * 1000 // width, window.step_ms * 1000 // width
    value = F.col(f"_f{at}")
    counted = rows.where(value.isNotNull()).groupBy(key, F.floor(F.col("_us") / width).alias("_slice"), value.alias("_value")).agg(F.count(F.lit(1)).alias("n"))
    counted = counted.withColumn("_bucket", bucket_of(F.col("_value")))
    rough = counted.groupBy(key, "_bucket", "_slice").agg(F.sum("n").alias("_p0"))
    slid = _slid(rough, [key, "_bucket"], n, step, {"_p0": "sum"}).withColumnRenamed("_slice", "_at")
    whole = Window.partitionBy(key, "_at")
    below = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = slid.withColumn("_before", F.coalesce(F.sum("_p0").over(below), F.lit(0))).withColumn("n_total", F.sum("_p0").over(whole))
    wanted = placed.where(holding([p for pick in picks.values() for p in pick.positions], "_before", "_p0"))
    block = F.floor(F.col("_at") / n)
    blocks = F.when(F.col("_at") % n == 0, F.array(block)).otherwise(F.array(block, block + 1))
    wanted = wanted.select(F.col(key).alias("_j_key"), F.col("_bucket").alias("_j_bucket"), "_at", "_before", "n_total", F.explode(blocks).alias("_j_block"))
    on = F.col(key).eqNullSafe(F.col("_j_key")) & (F.col("_bucket") == F.col("_j_bucket")) & (F.floor(F.col("_slice") / n) == F.col("_j_block"))
    met = counted.join(wanted, on).where((F.col("_slice") >= F.col("_at")) & (F.col("_slice") < F.col("_at") + n))
    values = met.groupBy(key, "_at", "_bucket", "_value", "_before", "n_total").agg(F.sum("n").alias("n"))
    within = Window.partitionBy(key, "_at", "_bucket").orderBy("_value").rowsBetween(Window.unboundedPreceding, -1)
    ordered = values.withColumn("n_before", F.col("_before") + F.coalesce(F.sum("n").over(within), F.lit(0)))
    return ordered.groupBy(key, (F.col("_at") * width).alias("_start")).agg(*[pick.column.alias(name) for name, pick in picks.items()])


def window_definitions(df: DataFrame, definitions: dict[str, tuple[str, object, list[Agg]]], **options) -> dict[str, DataFrame]:
    """Several window definitions over one source: one DataFrame, or one stream, for each."""
    return {name: window_aggregate(df, key, window, aggs, **options) for name, (key, window, aggs) in definitions.items()}
