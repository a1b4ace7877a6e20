"""Running window definitions over a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from quillon.operators.windows import Agg, window_aggregate


def window_writers(
    stream: DataFrame,
    definitions: dict[str, tuple[str, object, list[Agg]]],
    handler: Callable[[str, DataFrame, int], None],
    checkpoint: str,
    lateness: str = "10 seconds",
    **options,
) -> dict[str, DataStreamWriter]:
    """One streaming query per window definition; closed windows go to `handler(name, rows, batch)`.

    Each definition keeps its state under its own folder of `checkpoint`.
    """
    writers = {}
    for name, (key, window, aggs) in definitions.items():
        result = window_aggregate(stream, key, window, aggs, lateness=lateness, **options)

        def forward(batch: DataFrame, number: int, name: str = name) -> None:
            handler(name, batch, number)

        writers[name] = (
            result.writeStream.outputMode("append")
            .foreachBatch(forward)
            .option("checkpointLocation", f"{checkpoint.rstrip('/')}/{name}")
        )
    return writers
