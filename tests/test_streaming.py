"""Streams from files against the same call in batch."""

import datetime as dt
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import rows
from quillon.operators.runlog import MetricRule, metric_alerts
from quillon.operators.windows import Agg, Session, Sliding, Tumbling, window_aggregate
from quillon.streaming import exact, topics
from quillon.streaming.alerts import alert_transitions
from quillon.streaming.features import feature_writer
from quillon.streaming.windows import window_writers

SCHEMA = "event_id int, user string, ts timestamp, value double"


def put(spark, folder, name, data, schema=SCHEMA):
    """One more file for the stream to pick up."""
    spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{folder}/{name}")


def stream(spark, folder, schema=SCHEMA):
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(folder))


def drain(writer):
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return query


def at(minute, second=0):
    return dt.datetime(2024, 1, 1, 0, minute, second)


@pytest.mark.parametrize("window", [Tumbling(60_000), Sliding(120_000), Session(60_000)])
def test_stream_windows_equal_batch(spark, tmp_path, window):
    data = [(i, "ab"[i % 2], at(i % 20, i % 7), float(i)) for i in range(40)]
    put(spark, tmp_path / "in", "a", data[:20])
    put(spark, tmp_path / "in", "b", data[20:])
    put(spark, tmp_path / "in", "z", [(99, "end", at(59), 0.0)])
    aggs = [Agg("count"), Agg("sum", "value"), Agg("min", "value"), Agg("last", "value"), Agg("distinct_count", "event_id")]
    seen = []
    writers = window_writers(
        stream(spark, tmp_path / "in"), {"w": ("user", window, aggs)}, lambda name, df, n: seen.extend(map(tuple, df.collect())),
        str(tmp_path / "cp"), lateness="30 minutes",
    )
    drain(writers["w"])
    batch = window_aggregate(spark.createDataFrame(data, SCHEMA), "user", window, aggs)
    assert sorted((r for r in seen if r[0] != "end"), key=repr) == rows(batch)


def test_late_events_are_dropped_after_the_watermark(spark, tmp_path):
    put(spark, tmp_path / "in", "1", [(1, "u", at(0), 1.0)])
    put(spark, tmp_path / "in", "2", [(2, "u", at(10), 1.0)])
    put(spark, tmp_path / "in", "3", [(3, "u", at(11), 1.0)])
    put(spark, tmp_path / "in", "4", [(4, "u", at(0, 30), 1.0)])
    put(spark, tmp_path / "in", "5", [(5, "u", at(50), 1.0)])
    seen = []
    writers = window_writers(
        stream(spark, tmp_path / "in"), {"w": ("user", Tumbling(60_000), [Agg("count")])},
        lambda name, df, n: seen.extend(map(tuple, df.collect())), str(tmp_path / "cp"),
    )
    drain(writers["w"])
    assert [(r[1].minute, r[3]) for r in sorted(seen)] == [(0, 1), (10, 1), (11, 1)]


def record(i, **changes):
    base = {"event_id": str(i), "event_type": "metric", "event_name": "n", "source_service": "s", "payload": {"a": i}}
    base.update(changes)
    return ("topic", 0, i, json.dumps(base))


def test_consume_routes_and_rejects(spark, tmp_path):
    schema = "topic string, partition int, offset long, value string"
    data = [record(1), record(2, event_type="alert"), record(3, payload={}), ("topic", 0, 4, "{broken"), record(5)]
    put(spark, tmp_path / "in", "1", data, schema)
    metrics, rejected = [], []
    drain(
        topics.consume(
            stream(spark, tmp_path / "in", schema),
            {"metric": lambda df, n: metrics.extend(r["event_id"] for r in df.collect())},
            lambda df, n: rejected.extend(df.collect()),
            str(tmp_path / "cp"), group="g",
        )
    )
    assert sorted(metrics) == ["1", "5"]
    letters = {json.loads(r["value"])["original_offset"]: json.loads(r["value"]) for r in rejected}
    assert {r["topic"] for r in rejected} == {"topic.dlq"}
    assert letters[3]["error_message"] == "empty payload" and letters[4]["error_message"] == "not json"
    assert letters[4]["original_value"] == "{broken" and letters[4]["consumer_group"] == "g"


def test_topic_records(spark):
    df = spark.createDataFrame(
        [("e1", "metric", "n", "s", "1.0", dt.datetime(2024, 1, 1), "k1"), ("e2", "metric", "n", "s", "1.0", dt.datetime(2024, 1, 1), None)],
        "event_id string, event_type string, event_name string, source_service string, schema_version string, timestamp timestamp, user string",
    )
    got = topics.topic_records(df, "user", principal="me").orderBy("key").collect()
    assert [r["key"] for r in got] == ["e2", "k1"]
    headers = {h["key"]: bytes(h["value"]).decode() for h in got[0]["headers"]}
    assert headers == {"event_type": "metric", "event_name": "n", "source_service": "s", "schema_version": "1.0", "timestamp": "1704067200", "encrypted": "False", "principal": "me"}
    assert json.loads(got[0]["value"])["event_id"] == "e2"


def test_feature_stream(spark, tmp_path):
    schema = "entity_id string, age long, income long"
    put(spark, tmp_path / "in", "1", [("a", 30, 1000)], schema)
    put(spark, tmp_path / "in", "2", [("b", 40, 2500)], schema)
    out = str(tmp_path / "out")
    drain(
        feature_writer(
            stream(spark, tmp_path / "in", schema), {"user_age": "$age", "income_k": "$income / 1000"},
            lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"), str(tmp_path / "cp"),
        )
    )
    assert rows(spark.read.parquet(out), "entity_id", "feature_name", "value") == [
        ("a", "income_k", "1.0"), ("a", "user_age", "30"), ("b", "income_k", "2.5"), ("b", "user_age", "40"),
    ]


def test_alert_state_spans_batches(spark, tmp_path):
    schema = "id int, metric_name string, at timestamp, value double"
    data = [(i, "cpu", at(i), v) for i, v in enumerate([1.0, 9.0, 9.5, 2.0, 9.0, None, 1.0])]
    put(spark, tmp_path / "in", "1", data[:3], schema)
    put(spark, tmp_path / "in", "2", data[3:], schema)
    rules = [MetricRule("hot", "cpu", "greater_than", 5.0), MetricRule("cold", "cpu", "less_than", 1.5)]
    seen = []
    changes = alert_transitions(stream(spark, tmp_path / "in", schema), rules, "at")
    drain(
        changes.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "cp"))
        .foreachBatch(lambda df, n: seen.extend((r["rule_name"], r["at"].minute, r["transition"]) for r in df.collect()))
    )
    assert sorted(seen) == [
        ("cold", 0, "triggered"), ("cold", 1, "resolved"), ("cold", 6, "triggered"),
        ("hot", 1, "triggered"), ("hot", 2, "updated"), ("hot", 3, "resolved"), ("hot", 4, "triggered"), ("hot", 6, "resolved"),
    ]
    batch = metric_alerts(spark.createDataFrame(data, schema), rules, "at", "id", slice_seconds=120)
    assert rows(batch.select("rule_name", F.minute("at"), "transition")) == sorted(seen)


def test_alert_transitions_follow_event_time_over_batches(spark, tmp_path):
    """Readings dealt over batches out of order, equal ones, one too late; the same transitions as of the batch."""
    schema = "id int, metric_name string, value double, at timestamp"
    data = [(i, "load", float((i * 7) % 11), at((i * 13) % 30)) for i in range(30)] + [(30, "load", 9.0, at(12)), (31, "load", 9.0, at(12))]
    put(spark, tmp_path / "in", "a", data[::2], schema)
    put(spark, tmp_path / "in", "b", data[1::2], schema)
    put(spark, tmp_path / "in", "c", [(97, "load", 0.0, at(58))], schema)
    put(spark, tmp_path / "in", "d", [(98, "load", 10.0, at(3)), (99, "load", 0.0, at(59))], schema)
    rules = [MetricRule("hot", "load", "greater_than", 6.0), MetricRule("cold", "load", "less_than", 2.0)]
    seen = []
    changes = alert_transitions(stream(spark, tmp_path / "in", schema), rules, "at", "30 minutes")
    drain(
        changes.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "cp"))
        .foreachBatch(lambda df, n: seen.extend(map(tuple, df.select("rule_name", F.minute("at"), "value", "transition").collect())))
    )
    batch = metric_alerts(spark.createDataFrame(data, schema), rules, "at", "value", slice_seconds=120)
    want = rows(batch.select("rule_name", F.minute("at"), "value", "transition"))
    # The watermark ends at minute 29.
    assert sorted(seen) == sorted(r for r in want if r[1] < 29) and len(seen) > 20


EXACT = [Agg("count"), Agg("distinct_count", "value"), Agg("percentile", "value", 50, "p50"), Agg("first", "value"), Agg("max", "value")]


def closed(spark, tmp_path, files, window, aggs=EXACT, lateness="10 seconds"):
    """Rows that a stream over the files closes, and the query's progress."""
    for at_, data in enumerate(files):
        put(spark, tmp_path / "in", f"{at_:02d}", data)
    seen = []
    writers = window_writers(
        stream(spark, tmp_path / "in"), {"w": ("user", window, aggs)}, lambda name, df, n: seen.extend(map(tuple, df.collect())), str(tmp_path / "cp"), lateness=lateness
    )
    query = drain(writers["w"])
    return seen, query.recentProgress


@pytest.mark.parametrize("window", [Tumbling(60_000), Sliding(180_000, 60_000), Session(30_000)])
def test_exact_stream_aggregates_over_many_batches(spark, tmp_path, window):
    """Values repeated between batches, events out of order, ties in time, a null key and null values."""
    data = [
        (i, [None, "a", "b"][i % 3], at((i * 7) % 20, i % 50), None if i % 11 == 0 else float(i % 4)) for i in range(60)
    ] + [(100 + i, "a", at(5, 5), float(9 - i)) for i in range(5)]
    files = [data[i::5] for i in range(5)] + [[(999, "end", at(59), 0.0)]]
    seen, _ = closed(spark, tmp_path, files, window, lateness="30 minutes")
    batch = window_aggregate(spark.createDataFrame(data, SCHEMA), "user", window, EXACT)
    assert sorted((r for r in seen if r[0] != "end"), key=repr) == rows(batch)


def test_exact_stream_state_holds_open_windows_only(spark, tmp_path):
    files = [[(100 * minute + i, "u", at(minute, i), float(i)) for i in range(20)] for minute in range(12)]
    seen, progress = closed(spark, tmp_path, files, Tumbling(60_000))
    assert len(seen) == 11 and all(r[3:6] == (20, 20, 10.0) for r in seen)
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in progress]
    # One window open, one to be closed: counts of two fields, partials, span and timer of each.
    assert max(sizes) <= 3 * (2 * 20 + 3 + 1 + 2) and sizes[-1] <= max(sizes)


def test_exact_stream_drops_what_is_too_late(spark, tmp_path):
    files = [[(1, "u", at(0), 1.0)], [(2, "u", at(10), 1.0)], [(3, "u", at(0, 30), 5.0), (4, "u", at(9, 59), 7.0)], [(5, "u", at(50), 1.0)]]
    seen, _ = closed(spark, tmp_path, files, Tumbling(60_000))
    assert [(r[1].minute, r[3]) for r in sorted(seen)] == [(0, 1), (9, 1), (10, 1)]


def test_a_late_event_joins_two_open_sessions(spark, tmp_path):
    files = [[(1, "u", at(0), 1.0)], [(2, "u", at(1, 20), 2.0)], [(3, "u", at(0, 40), 3.0)], [(4, "u", at(40), 4.0)]]
    seen, _ = closed(spark, tmp_path, files, Session(50_000), lateness="5 minutes")
    assert [(r[1].minute, r[2].minute, *r[3:]) for r in seen] == [(0, 2, 3, 3, 2.0, 1.0, 3.0)]


class Held:
    """A processor's state in memory, counting the calls that write."""

    def __init__(self):
        self.writes, self.timers = 0, []

    def getMapState(self, name, key, value):
        return HeldMap(self)

    def getValueState(self, name, schema):
        return HeldValue(self)

    def registerTimer(self, ms):
        self.timers.append(ms)
        self.writes += 1


class HeldMap(dict):
    def __init__(self, owner):
        self.owner = owner

    def updateValue(self, key, value):
        self[key] = value
        self.owner.writes += 1

    def getValue(self, key):
        return self.get(key)

    def containsKey(self, key):
        return key in self

    def iterator(self):
        return iter(list(self.items()))

    def removeKey(self, key):
        self.pop(key, None)


class HeldValue:
    def __init__(self, owner):
        self.owner, self.value = owner, None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value
        self.owner.writes += 1

    def clear(self):
        self.value = None


class Times:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms

    def getExpiryTimeInMs(self):
        return self.ms


@pytest.mark.parametrize("most", [1, 1 << 20])
@pytest.mark.parametrize("kind", ["window", "sessions"])
def test_exact_stream_state_takes_a_piece_of_input_in_few_calls(monkeypatch, kind, most):
    """However many values it has; a window of more values than may be held together is read part by part, to the same results."""
    monkeypatch.setattr(exact, "HELD", most, raising=False)
    aggs = [Agg("count"), Agg("distinct_count", "x"), Agg("percentile", "y", 70)]
    made = exact.FixedWindow(aggs) if kind == "window" else exact.Sessions(aggs, 10)
    state = Held()
    made.init(state)
    key, y = ("u", 0, 10_000_000), [(-1.0) ** i * (i % 77) / 7 for i in range(900)]
    rows_ = pd.DataFrame({"us": [i + (10_000 if i >= 600 else 0) for i in range(900)], "tie": [str(i) for i in range(900)], "f1": [f"v{i % 450}" for i in range(900)], "f2": y})
    list(made.handleInputRows(key, iter([rows_[::2], rows_[1::2]]), Times(0)))
    assert state.writes <= 8
    got = pd.concat(made.handleExpiredTimer(key, Times(10_000), Times(10_000)))
    parts = [y] if kind == "window" else [y[:600], y[600:]]
    want = [(len(p), min(len(p), 450), sorted(p)[int(len(p) * 0.7)]) for p in parts]
    assert [tuple(r) for r in got[["r0", "r1", "r2"]].itertuples(index=False)] == want
