"""Metric alerts over a stream, with the on/off state of each rule kept by Spark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillon.operators.runlog import MetricRule, readings_by_rule

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Transitions(StatefulProcessor):
    """Emits triggered, updated and resolved; the state is one flag per rule.

    Readings of one micro-batch are put in time order, so bound the source's rate per trigger.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.active = handle.getValueState("active", "active boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        readings = pd.concat(list(rows)).sort_values(["at", "value"])
        active = bool(self.active.get()[0]) if self.active.exists() else False
        changes = []
        for holds in readings["holds"]:
            changes.append("updated" if holds and active else "triggered" if holds else "resolved" if active else None)
            active = bool(holds)
        self.active.update((active,))
        out = readings.assign(transition=changes)
        yield out.loc[out["transition"].notna(), ["rule_name", "at", "value", "transition"]]

    def close(self) -> None:
        pass


class OrderedTransitions(StatefulProcessor):
    """Transitions in the order of event time, whatever batch a reading came with.

    Readings wait in the state, equal ones counted, until the watermark has passed them; then those that are due are
    put in order and change the rule's flag. Timers stand at whole seconds, and the first of a batch settles all that is due.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.active = handle.getValueState("active", "active boolean")
        self.settled = handle.getValueState("settled", "ms long")
        self.waiting = handle.getMapState("waiting", "us long, value double", "n long, holds boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        for frame in rows:
            frame = frame[frame["us"] >= mark]
            for (us, value, holds), n in frame.groupby(["us", "value", "holds"], dropna=False).size().items():
                place = (int(us), float(value))
                have = self.waiting.getValue(place) if self.waiting.containsKey(place) else None
                self.waiting.updateValue(place, (int(n) + (have[0] if have else 0), bool(holds)))
            for second in (-(-frame["us"] // 1_000_000)).unique().tolist():
                self.handle.registerTimer(max(second * 1000, 0) + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        if self.settled.exists() and self.settled.get()[0] == mark:
            return
        self.settled.update((mark,))
        due = sorted((us, value, n, holds) for (us, value), (n, holds) in list(self.waiting.iterator()) if us < mark * 1000)
        active = bool(self.active.get()[0]) if self.active.exists() else False
        out = []
        for us, value, n, holds in due:
            self.waiting.removeKey((us, value))
            for _ in range(n):
                change = "updated" if holds and active else "triggered" if holds else "resolved" if active else None
                active = holds
                if change:
                    out.append((key[0], us, value, change))
        if due:
            self.active.update((active,))
        if out:
            yield pd.DataFrame(out, columns=["rule_name", "us", "value", "transition"])

    def close(self) -> None:
        pass


def alert_transitions(stream: DataFrame, rules: list[MetricRule], time: str, lateness: str | None = None) -> DataFrame:
    """Stream of (rule_name, at, value, transition). Needs the RocksDB state store (STATE_STORE).

    With a lateness, readings are taken in the order of their time over all batches once the watermark has passed them,
    and those later than it are left out, as are those without a time. Without one, they are ordered within each micro-batch only.
    """
    rows = readings_by_rule(stream, rules).selectExpr("rule_name", f"CAST(`{time}` AS timestamp) AS at", "value", "holds")
    if lateness is not None:
        timed = rows.where(F.col("at").isNotNull()).withColumn("us", F.unix_micros("at")).withColumn("value", F.col("value").cast("double"))
        made = timed.withWatermark("at", lateness).groupBy("rule_name").transformWithStateInPandas(
            statefulProcessor=OrderedTransitions(),
            outputStructType="rule_name string, us long, value double, transition string",
            outputMode="Append",
            timeMode="EventTime",
        )
        return made.select("rule_name", F.timestamp_micros("us").alias("at"), "value", "transition")
    return rows.groupBy("rule_name").transformWithStateInPandas(
        statefulProcessor=Transitions(),
        outputStructType="rule_name string, at timestamp, value double, transition string",
        outputMode="Append",
        timeMode="None",
    )
