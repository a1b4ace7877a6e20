"""Exact distinct counts and percentiles over stream windows, by state and timers.

Spark's own stream aggregations only have approximate forms of both. Here the state of a window is
chunks: for each piece of input the values of each such aggregation, repeated ones once with their count, and one partial
result for each other. A piece of input costs a few calls of the state, however many values it has. A timer at the window's
end reads the chunks one by one, emits the row and clears them, so the state holds the open windows only; more than HELD
values are never in memory together, but compared part by part over several readings.
"""

from __future__ import annotations

import math
import pickle
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillon.operators.windows import Agg, Session, Tumbling, _prepared, _starts

COUNTED = {"distinct_count", "percentile"}
NUMBERS = {"sum", "avg", "min", "max", "percentile"}
#: The fields of a partial result: rows, total, time, tie, value as text, number.
NONE = (0, 0.0, None, None, None, None)
#: Values that are compared in memory at once.
HELD = 1 << 20


def _counts(kind: str, values: np.ndarray) -> tuple:
    """Values and how often each occurs, in built-in types: texts, or numbers as bytes of doubles."""
    if kind == "percentile":
        number, n = np.unique(values[~np.isnan(values)] + 0.0, return_counts=True)
        return number.tobytes(), n.astype("int64").tobytes()
    return tuple(set(map(str, values[~pd.isna(values)].tolist()))), None


def _partial(kind: str, values: np.ndarray, times: np.ndarray, ties: np.ndarray) -> tuple:
    """One batch's part of an aggregation, in the fields of a partial result."""
    if kind == "count":
        return (len(times), *NONE[1:])
    kept = np.flatnonzero(~pd.isna(values))
    if not len(kept):
        return NONE
    if kind in ("sum", "avg"):
        return (len(kept), float(values[kept].sum()), *NONE[2:])
    if kind in ("min", "max"):
        return (len(kept), *NONE[1:5], float(values[kept].min() if kind == "min" else values[kept].max()))
    pick = min if kind == "first" else max
    at = times[kept].min() if kind == "first" else times[kept].max()
    # Ties sort as in a batch: numbers by size, null first.
    tie, value = pick(((None if pd.isna(ties[i]) else ties[i], values[i]) for i in kept[times[kept] == at]), key=lambda p: _order(*p))
    return (len(kept), 0.0, int(at), tie, str(value), None)


def _order(tie: str | None, value: object) -> tuple:
    try:
        return (tie is not None, 0, float(tie or 0), tie or "", str(value))
    except ValueError:
        return (True, 1, 0.0, tie, str(value))


def _joined(kind: str, a: tuple, b: tuple) -> tuple:
    """Two partial results as one."""
    if not a[0] or not b[0]:
        return b if b[0] else a
    n = a[0] + b[0]
    if kind in ("count", "sum", "avg"):
        return (n, a[1] + b[1], *NONE[2:])
    if kind in ("min", "max"):
        return (n, *NONE[1:5], (min if kind == "min" else max)(a[5], b[5]))
    pick = (min if kind == "first" else max)(a, b, key=lambda p: (p[2], _order(p[3], p[4])))
    return (n, 0.0, *pick[2:])


def _result(kind: str, part: tuple):
    match kind:
        case "count":
            return part[0]
        case "sum":
            return part[1]
        case "avg":
            return part[1] / part[0] if part[0] else 0.0
        case "min" | "max":
            return part[5]
    return part[4]


def _buckets(numbers: np.ndarray, shift: int) -> np.ndarray:
    """The leading bits of doubles as unsigned numbers that sort as they do."""
    bits = numbers.view("uint64")
    top = np.uint64(1 << 63)
    return np.where(bits & top, ~bits, bits | top) >> np.uint64(shift)


def _distinct(texts: Callable[[], Iterator[tuple]], size: int) -> int:
    """How many texts differ, by as many readings as their number needs to be compared a part at a time."""
    parts = 1 + size // HELD
    if parts == 1:
        return len({text for some in texts() for text in some})
    return sum(len({text for some in texts() for text in some if zlib.crc32(text.encode()) % parts == part}) for part in range(parts))


def _indexed(counts: Callable[[], Iterator[tuple]], size: int, percent: float) -> float | None:
    """The value at min(int(n * percent / 100), n - 1) of the sorted values, by a histogram a reading until what is left fits."""
    arrays = lambda: ((np.frombuffer(v, "float64"), np.frombuffer(n, "int64")) for v, n in counts())
    total = int(sum(n.sum() for _, n in arrays()))
    if not total:
        return None
    index, shift, inside = min(math.floor(total * percent / 100.0), total - 1), 64, None
    while size > HELD and shift:
        shift -= 16
        seen, entries = np.zeros(1 << 16, "int64"), np.zeros(1 << 16, "int64")
        for numbers, n in arrays():
            bucket = _buckets(numbers, shift)
            if inside is not None:
                own = bucket >> np.uint64(16) == inside
                bucket, n = bucket[own], n[own]
            low = (bucket & np.uint64(0xFFFF)).astype("int64")
            np.add.at(seen, low, n)
            np.add.at(entries, low, 1)
        place = int(np.searchsorted(np.cumsum(seen), index, "right"))
        index -= int(seen[:place].sum())
        size, inside = int(entries[place]), np.uint64(((int(inside) if inside is not None else 0) << 16) + place)
    if not shift:  # all bits are known: one value is left
        key = int(inside)
        return float(np.array([key ^ (1 << 63) if key >> 63 else ~key & ((1 << 64) - 1)], "uint64").view("float64")[0])
    if inside is None:
        kept = list(arrays())
    else:
        kept = [(numbers[own], n[own]) for numbers, n in arrays() if (own := _buckets(numbers, shift) == inside).any()]
    numbers, n = (np.concatenate(part) for part in zip(*kept))
    order = np.argsort(numbers, kind="stable")
    return float(numbers[order][np.searchsorted(np.cumsum(n[order]), index, "right")])


class _Windows(StatefulProcessor):
    """Common to fixed windows and sessions: chunks of runs, a run being what one micro-batch adds to one window.

    The head says which chunks there are and how many values they hold, and the spans of the open windows. A chunk is
    written once per piece of input and read when a window ends, chunk by chunk.
    """

    def __init__(self, aggs: list[Agg], gap_us: int = 0):
        self.aggs, self.gap = aggs, gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "head binary")
        self.chunks = handle.getMapState("chunks", "number long", "runs binary")

    def opened(self) -> tuple[dict[int, int], list[tuple[int, int]]]:
        """Values by chunk, and spans."""
        held = self.head.get()
        return pickle.loads(held[0]) if held else ({}, [])

    def keep(self, sizes: dict[int, int], spans: list[tuple[int, int]]) -> None:
        if sizes:
            self.head.update((pickle.dumps((sizes, spans)),))
        else:
            self.head.clear()

    def write(self, sizes: dict[int, int], number: int, runs: list[tuple]) -> None:
        values = (part[0] for _, _, parts in runs for part in parts if len(part) == 2)
        sizes[number] = sum(len(some) // (8 if isinstance(some, bytes) else 1) for some in values)
        self.chunks.updateValue((number,), (pickle.dumps(runs),))

    def read(self, number: int) -> list[tuple]:
        return pickle.loads(self.chunks.getValue((number,))[0])

    def runs(self, frame: pd.DataFrame, cuts: list[int]) -> list[tuple]:
        """(low, high, parts) of the rows from each cut to the next."""
        times, ties = frame["us"].to_numpy(), frame["tie"].to_numpy()
        columns = []
        for at, agg in enumerate(self.aggs):
            values = frame[f"f{at}"] if agg.field is not None else frame["us"]
            columns.append(values.to_numpy(dtype="float64", na_value=np.nan) if agg.kind in NUMBERS else values.to_numpy())
        found = []
        for low, high in zip(cuts, [*cuts[1:], len(frame)]):
            parts = [
                _counts(agg.kind, values[low:high]) if agg.kind in COUNTED else _partial(agg.kind, values[low:high], times[low:high], ties[low:high])
                for agg, values in zip(self.aggs, columns)
            ]
            found.append((int(times[low:high].min()), int(times[low:high].max()), parts))
        return found

    def results(self, runs: Callable[[], Iterator[list]], size: int) -> list:
        """The aggregations of a window, from what reads the parts of its runs."""
        plain = {at: NONE for at, agg in enumerate(self.aggs) if agg.kind not in COUNTED}
        if plain:
            for parts in runs():
                for at in plain:
                    plain[at] = _joined(self.aggs[at].kind, plain[at], parts[at])
        row = []
        for at, agg in enumerate(self.aggs):
            if agg.kind == "distinct_count":
                row.append(_distinct(lambda at=at: (parts[at][0] for parts in runs()), size))
            elif agg.kind == "percentile":
                row.append(_indexed(lambda at=at: (parts[at] for parts in runs()), size, agg.percentile))
            else:
                row.append(_result(agg.kind, plain[at]))
        return row

    def frame(self, key, rows: list[tuple]) -> pd.DataFrame:
        """(start, end, results) of closed windows as rows to return."""
        names = ["k", "start", "end", *[f"r{at}" for at in range(len(self.aggs))]]
        return pd.DataFrame([(key[0], start, end, *made) for start, end, made in rows], columns=names)

    def timer(self, end_us: int) -> None:
        self.handle.registerTimer(max(-(-end_us // 1000), 0))

    def close(self) -> None:
        pass


class FixedWindow(_Windows):
    """The state of one key and window; the group is (key, start, end)."""

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        start, end = int(key[1]), int(key[2])
        if end <= timerValues.getCurrentWatermarkInMs() * 1000:
            for _ in rows:
                pass  # too late
            return iter(())
        sizes, _ = self.opened()
        if not sizes:
            self.timer(end)
        for frame in rows:
            self.write(sizes, len(sizes), self.runs(frame, [0]))
        self.keep(sizes, [(start, end)])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        start, end = int(key[1]), int(key[2])
        sizes, _ = self.opened()
        if not sizes:
            return
        if end > timerValues.getCurrentWatermarkInMs() * 1000:
            self.handle.registerTimer(-(-end // 1000) + 1)
            return
        yield self.frame(key, [(start, end, self.results(lambda: (parts for number in sizes for _, _, parts in self.read(number)), sum(sizes.values())))])
        for number in sizes:
            self.chunks.removeKey((number,))
        self.keep({}, [])


class Sessions(_Windows):
    """The open sessions of one key. A session ends once the watermark has passed its last event by more than the gap."""

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        sizes, spans = self.opened()
        number = max(sizes, default=-1)
        for frame in rows:
            times = frame["us"].to_numpy()
            order = np.argsort(times, kind="stable")
            order = order[times[order] >= mark]
            if not len(order):
                continue
            runs = self.runs(frame.iloc[order], [0, *(np.flatnonzero(np.diff(times[order]) > self.gap) + 1).tolist()])
            self.write(sizes, number := number + 1, runs)
            spans = self.joined(spans + [run[:2] for run in runs])
        if sizes:
            self.keep(sizes, spans)
            self.timer(min(high for _, high in spans) + self.gap + 1)
        return iter(())

    def joined(self, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Spans in order, those at most the gap apart made one."""
        made: list[tuple[int, int]] = []
        for low, high in sorted(spans):
            if made and low <= made[-1][1] + self.gap:
                made[-1] = (made[-1][0], max(high, made[-1][1]))
            else:
                made.append((low, high))
        return made

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Closes what the watermark has passed and sets a timer at the next end."""
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        sizes, spans = self.opened()
        ended, left = [span for span in spans if span[1] + self.gap < mark], [span for span in spans if span[1] + self.gap >= mark]
        if ended:
            yield self.frame(key, self.closed(sizes, ended))
            lows = {low for low, _ in ended}
            starts = [low for low, _ in spans]
            for number in list(sizes):
                runs = self.read(number)
                kept = [run for run in runs if starts[bisect_right(starts, run[0]) - 1] not in lows]
                if not kept:
                    self.chunks.removeKey((number,))
                    del sizes[number]
                elif len(kept) < len(runs):
                    self.write(sizes, number, kept)
            self.keep(sizes, left)
        if left:
            self.timer(min(high for _, high in left) + self.gap + 1)

    def closed(self, sizes: dict[int, int], ended: list[tuple[int, int]]) -> list[tuple]:
        """(start, end, results) of sessions that ended. Chunks are held together while they are few, else read for each session."""
        size = sum(sizes.values())
        if size > HELD:
            inside = lambda low, high: (parts for number in sizes for a, _, parts in self.read(number) if low <= a <= high)
            return [(low, high + self.gap, self.results(lambda low=low, high=high: inside(low, high), size)) for low, high in ended]
        held = sorted(((a, n, parts) for n, number in enumerate(sizes) for a, _, parts in self.read(number)), key=lambda run: run[:2])
        lows, made = [run[0] for run in held], []
        for low, high in ended:
            own = [parts for _, _, parts in held[bisect_left(lows, low) : bisect_right(lows, high)]]
            made.append((low, high + self.gap, self.results(lambda own=own: iter(own), size)))
        return made


def _as_text(value: Column, kind: T.DataType) -> Column:
    """A value as text that tells it from all others of its type."""
    return F.to_json(F.struct(value.alias("v"))) if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)) else value.cast("string")


def exact_windows(stream: DataFrame, key: str, window, aggs: list[Agg], time: str = "ts", tie: str = "event_id", lateness: str = "10 seconds") -> DataFrame:
    """Closed windows of a stream, in append mode, with every aggregation as exact as in a batch.

    One row per key and window: key, window_start, window_end and the aggregations. Tumbling and sliding windows keep
    state per key and window, sessions per key. Needs the RocksDB state store. Rows without a time belong to no window;
    first and last values come back as their field's type, which must be atomic.
    """
    kinds = {}
    rows = _prepared(stream.withColumn(time, F.col(time).cast("timestamp")), key, aggs, time, tie).where(F.col("_us").isNotNull())
    # Names that pandas rows can carry, whatever the stream's columns are called.
    fields = []
    for at, agg in enumerate(aggs):
        if agg.field is not None:
            kinds[at] = rows.schema[f"_f{at}"].dataType
            fields.append((F.col(f"_f{at}") if agg.kind in NUMBERS else _as_text(F.col(f"_f{at}"), kinds[at])).alias(f"f{at}"))
    key_type = rows.schema[key].dataType
    rows = rows.select(F.col(key).alias("k"), F.col(time).alias("time"), F.col("_us").alias("us"), F.col("_tie").cast("string").alias("tie"), *fields)
    rows = rows.withWatermark("time", lateness)
    out = {"count": "long", "distinct_count": "long", "first": "string", "last": "string"}
    made = ", ".join(f"r{at} {out.get(agg.kind, 'double')}" for at, agg in enumerate(aggs))
    schema = f"k {key_type.simpleString()}, start long, end long, {made}"
    if isinstance(window, Session):
        grouped, processor = rows.groupBy("k"), Sessions(aggs, window.gap_ms * 1000)
    else:
        size = window.size_ms * 1000
        step = size if isinstance(window, Tumbling) else window.step_ms * 1000
        placed = rows.withColumn("start", F.explode(_starts(F.col("us"), size, step))).withColumn("end", F.col("start") + size)
        grouped, processor = placed.groupBy("k", "start", "end"), FixedWindow(aggs)
    closed = grouped.transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")
    results = []
    for at, agg in enumerate(aggs):
        value = F.col(f"r{at}")
        results.append((value.cast(kinds[at]) if agg.kind in ("first", "last") and at in kinds else value).alias(agg.label))
    return closed.select(F.col("k").alias(key), F.timestamp_micros("start").alias("window_start"), F.timestamp_micros("end").alias("window_end"), *results)
