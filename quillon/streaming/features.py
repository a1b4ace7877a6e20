"""Feature rows from a stream, written per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import DataStreamWriter

from quillon.operators.features import feature_rows


def feature_writer(
    stream: DataFrame,
    expressions: dict[str, str],
    write: Callable[[DataFrame, int], None],
    checkpoint: str,
    timestamp: Column | None = None,
) -> DataStreamWriter:
    """Long feature rows of every micro-batch go to `write(rows, batch)`.

    `write` gets the batch number, which it can use to stay idempotent when a batch is replayed.
    """
    rows = feature_rows(stream, expressions, timestamp)
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
