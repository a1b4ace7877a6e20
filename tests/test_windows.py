"""Wide sliding windows and long sessions against brute force, and the shape of their plans."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from quillon.functions.ordering import bucket_of, indexed_quantile, linear_quantile, quantiles
from quillon.operators import windows
from quillon.operators.windows import Agg, Session, Sliding, window_aggregate

BEGIN = dt.datetime(1969, 12, 31, 23, 0, tzinfo=dt.timezone.utc)
AGGS = [
    Agg("count"), Agg("sum", "value"), Agg("avg", "value"), Agg("min", "value"), Agg("max", "value"), Agg("first", "kind"), Agg("last", "kind"),
    Agg("distinct_count", "kind"), Agg("percentile", "value", 50, "p50"), Agg("percentile", "value", 90, "p90"),
]


def made_rows(seed, n, seconds):
    r = random.Random(seed)
    return [
        (i, r.choice(["hot", "hot", "hot", "b", None]), r.randrange(seconds) * 1000 - 3_600_000, r.choice([None, float(r.randrange(-9, 9)), r.random() * 1e6]), r.choice(["x", "y", None, "z"]))
        for i in range(n)
    ]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "event_id int, user string, ms long, value double, kind string")
    return df.withColumn("ts", F.timestamp_millis("ms")).repartition(3)


def answer(rows):
    """Every aggregation of AGGS over the rows of one window."""
    values = sorted(r[3] for r in rows if r[3] is not None)
    kinds = [r[4] for r in sorted(rows, key=lambda r: (r[2], r[0])) if r[4] is not None]
    pick = lambda p: values[min(int(len(values) * p / 100), len(values) - 1)] if values else None
    total = sum(values)
    return (
        len(rows), round(total, 3), round(total / len(values), 3) if values else 0.0, min(values, default=None), max(values, default=None),
        kinds[0] if kinds else None, kinds[-1] if kinds else None, len(set(kinds)), pick(50), pick(90),
    )


def found(df):
    out = {}
    for r in df.select("*", F.unix_millis("window_start").alias("s"), F.unix_millis("window_end").alias("e")).collect():
        row = [r[a.label] for a in AGGS]
        out[r["user"], r["s"], r["e"]] = (row[0], round(row[1], 3), round(row[2], 3), *row[3:])
    return out


@pytest.mark.parametrize("size, slide, seconds", [
    (40, 1, 300), (40, 1, 20_000), (12, 5, 200), (100, 3, 4000), (90, 10, 3000), (7, 20, 500), (1000, 1, 1500), (20, 20, 300),
])
def test_sliding_windows_against_brute_force(spark, size, slide, seconds):
    rows = made_rows(size + slide, 150, seconds)
    want = {}
    for r in rows:
        last = r[2] // (slide * 1000) * slide * 1000
        start = last
        while start > r[2] - size * 1000:
            want.setdefault((r[1], start, start + size * 1000), []).append(r)
            start -= slide * 1000
    got = found(window_aggregate(frame(spark, rows), "user", Sliding(size * 1000, slide * 1000), AGGS))
    assert got == {k: answer(v) for k, v in want.items()}


def test_an_empty_table_has_no_windows(spark):
    empty = frame(spark, [])
    assert window_aggregate(empty, "user", Sliding(60_000, 1000), AGGS).collect() == []
    assert window_aggregate(empty, "user", Session(1000), AGGS).collect() == []


def test_wide_windows_read_each_slice_twice(spark):
    """Dense slices: every slice opens one window, and no part of it is copied to the others."""
    rows = [(i, "u", i * 1000, 1.0, "x") for i in range(2000)]
    n = 500
    slices = spark.createDataFrame([("u", i, 1) for i in range(2000)], "user string, _slice long, _p0 long")
    opened = windows._opened(slices, ["user"], n, 1, F.floor(F.col("_slice") / n)).count()
    assert opened <= 2000 + 3 * n + n  # the windows, and for each block those before it
    made = window_aggregate(frame(spark, rows), "user", Sliding(n * 1000, 1000), [Agg("count")])
    assert made.count() == 2000 + n - 1
    plan = plan_of(made)
    assert "window" not in plan.split("Generate", 1)[0].lower() or "_block" in plan
    for line in plan.splitlines():
        if "Window [" in line:
            assert "_block" in line.split("]")[1] + line  # no window function goes by the key alone


@pytest.mark.parametrize("gap, seconds", [(3, 400), (30, 3000), (1, 900), (200, 500)])
def test_sessions_over_many_ranges_against_brute_force(spark, monkeypatch, gap, seconds):
    monkeypatch.setattr(windows, "RANGE", 4)
    rows = made_rows(gap, 160, seconds)
    want = {}
    by_key = {}
    for r in sorted(rows, key=lambda r: r[2]):
        own = by_key.setdefault(r[1], [])
        if not own or r[2] - own[-1][-1][2] > gap * 1000:
            own.append([])
        own[-1].append(r)
    for key, sessions in by_key.items():
        for s in sessions:
            want[key, s[0][2], s[-1][2] + gap * 1000] = answer(s)
    assert found(window_aggregate(frame(spark, rows), "user", Session(gap * 1000), AGGS)) == want


def test_a_hot_key_is_spread_over_time_ranges(spark):
    rows = [(i, "hot", i * 500, 1.0, "x") for i in range(4000)]
    mapped = windows._session_map(windows._prepared(frame(spark, rows), "user", [Agg("count")], "ts", "event_id"), "user", Session(1), [F.count("*").alias("_p0")])
    lines = [line for line in plan_of(mapped).splitlines() if "Sort [user" in line and "_slice" in line]
    assert lines and all("_range" in line for line in lines)


@pytest.mark.parametrize("values", [
    [1e12 + i * 1e-3 for i in range(500)], [0.0, -0.0, float("inf"), float("-inf"), 5e-324, -5e-324, 1e308], [float("nan"), 1.0, 2.0, float("nan")], [7.0] * 50,
    [random.Random(3).gauss(0, 1) ** 5 for _ in range(400)],
])
def test_quantiles_of_odd_values(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    order = [r[0] for r in df.orderBy("v").collect()]
    got = quantiles(df, [], "v", {f"p{p}": indexed_quantile("v", p) for p in (0, 25, 50, 99, 100)}).first()
    want = [order[min(int(len(order) * p / 100), len(order) - 1)] for p in (0, 25, 50, 99, 100)]
    assert [str(x + 0.0) for x in got] == [str(x + 0.0) for x in want]
    buckets = [r[0] for r in df.orderBy("v").select(bucket_of(F.col("v"))).collect()]
    assert buckets == sorted(buckets)


def test_quantiles_read_only_the_wanted_values(spark):
    df = spark.range(100_000).select((F.col("id") % 1000 + 1).cast("double").alias("v"))
    made = quantiles(df, [], "v", {"q": linear_quantile("v", 0.5)})
    assert made.collect()[0]["q"] == 500.5
    final = plan_of(made).split("Initial Plan")[0]
    assert final.count("Range (0, 100000") == 2 and "ReusedExchange" in final
