"""Looking back along time without sorting a whole key in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def with_previous(df: DataFrame, keys: list[str], time: str, tie: str, value: Column, name: str, slice_seconds: int) -> DataFrame:
    """Add `name`: `value` of the row before, by time and tie, within the keys; null for the first.

    Rows are sorted inside time slices. The first row of a slice takes the last value of the
    slice before it, so a hot key is spread over its slices.
    """
    width = slice_seconds * 1_000_000
    rows = df.withColumn("_value", value).withColumn(
        "_slice", F.floor(F.unix_micros(F.col(time).cast("timestamp")) / F.lit(width))
    )
    last = rows.groupBy(*keys, "_slice").agg(F.max(F.struct(time, tie, "_value")).getField("_value").alias("_last"))
    carried = last.select(
        *[F.col(key).alias(f"_s_{key}") for key in keys],
        F.col("_slice").alias("_s_slice"),
        F.lag("_last").over(Window.partitionBy(*keys).orderBy("_slice")).alias("_carried"),
    )
    on = F.col("_slice") == F.col("_s_slice")
    on = reduce(lambda a, key: a & F.col(key).eqNullSafe(F.col(f"_s_{key}")), keys, on)
    inside = Window.partitionBy(*keys, "_slice").orderBy(time, tie)
    looked = rows.withColumn("_first", F.row_number().over(inside) == 1).withColumn("_before", F.lag("_value").over(inside))
    return looked.join(carried, on).select(
        *df.columns, F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_before")).alias(name)
    )
