"""Combining the results of several sources."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, functions as F

from quillon.operators.olap import AGGREGATIONS
from quillon.session import stored


def union_sources(sources: list[DataFrame]) -> DataFrame:
    """All rows, in the columns of the first source: missing ones null, extra ones dropped."""
    first = sources[0]

    def aligned(df: DataFrame) -> DataFrame:
        return df.select(
            *[
                F.col(f"`{column.name}`") if column.name in df.columns else F.lit(None).cast(column.dataType).alias(column.name)
                for column in first.schema.fields
            ]
        )

    return reduce(lambda left, right: left.unionAll(aligned(right)), sources[1:], first)


def join_sources(sources: list[DataFrame], keys: list[str], order: list[str]) -> DataFrame:
    """Chained inner join on `keys`, where null meets null.

    Before each step the left side keeps one row per key, the last one by its `order` column
    (`order[i]` belongs to `sources[i]`), as a max over a struct that is combined before the
    shuffle. The right side keeps all its rows, so after that step the left is unique and a hot
    key only makes the right side long, which the adaptive skew join splits. Key columns that a
    source lacks are left out of its step; a source with none is skipped.
    """
    used = [key for key in keys if key in sources[0].columns]
    if len(sources) < 2 or not used:
        return union_sources(sources)
    left, left_order = sources[0], order[0]
    for right, right_order in zip(sources[1:], order[1:]):
        on_keys = [key for key in used if key in right.columns]
        if not on_keys:
            continue
        unique = last_per_key(left, on_keys, left_order)
        renamed = right.select(*[F.col(c).alias(f"_right_{c}") if c in on_keys else F.col(c) for c in right.columns])
        match = reduce(
            lambda a, b: a & b,
            [unique[key].eqNullSafe(renamed[f"_right_{key}"]) for key in on_keys],
        )
        extra = [c for c in right.columns if c not in on_keys]
        left = unique.join(renamed, match).select(*[unique[c] for c in left.columns], *[renamed[c] for c in extra])
        left_order = right_order
    return left


def last_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the largest `order` per key; the other columns settle ties."""
    rest = [c for c in df.columns if c not in keys and c != order]
    if order in keys:
        picked = F.max(F.struct(*rest)) if rest else None
    else:
        picked = F.max(F.struct(order, *rest))
    if picked is None:
        return df.select(*keys).distinct()
    return df.groupBy(*keys).agg(picked.alias("_last")).select(
        *[F.col(c) if c in keys else F.col("_last").getField(c).alias(c) for c in df.columns]
    )


def merge_sources(sources: list[DataFrame], keys: list[str], aggregation: dict[str, str]) -> DataFrame:
    """Union, then one aggregation per named column within the keys."""
    merged = union_sources(sources)
    return merged.groupBy(*keys).agg(
        *[AGGREGATIONS[how](column).alias(column) for column, how in aggregation.items()]
    )


@dataclass
class Federated:
    combined: DataFrame | None
    errors: dict[str, str] = field(default_factory=dict)
    success: bool = True


def federate(
    sources: dict[str, Callable[[], DataFrame]],
    strategy: str = "union",
    keys: list[str] | None = None,
    order: dict[str, str] | None = None,
    aggregation: dict[str, str] | None = None,
    tries: int = 2,
) -> Federated:
    """Run every source, leave out and report the ones that fail, combine the others.

    Each source is written to the shared folder, so that a failure while it runs is met here too; it is tried
    `tries` times. An unknown strategy, or a join without keys, falls back to the union.
    """
    built, errors = {}, {}
    for name, make in sources.items():
        for _ in range(tries):
            try:
                built[name] = stored(make(), "source")
                errors.pop(name, None)
                break
            except (PySparkException, Py4JJavaError, ValueError, OSError) as error:
                errors[name] = str(error)
    frames = list(built.values())
    if not frames:
        combined = None
    elif strategy == "join" and keys:
        combined = join_sources(frames, keys, [(order or {}).get(name, keys[0]) for name in built])
    elif strategy == "merge" and keys and aggregation:
        combined = merge_sources(frames, keys, aggregation)
    else:
        combined = union_sources(frames)
    return Federated(combined, errors, not errors)
