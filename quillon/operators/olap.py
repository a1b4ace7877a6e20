"""Cube queries over a DataFrame.

A query is plain data; operations return changed copies of it; `Cube.query` turns it into
filter, group, having, order and limit calls for Catalyst to plan.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

AGGREGATIONS: dict[str, Callable[[str], Column]] = {
    "sum": F.sum,
    "count": F.count,
    "avg": F.avg,
    "min": F.min,
    "max": F.max,
    "count_distinct": F.count_distinct,
    "stddev": F.stddev_samp,
    "variance": F.var_samp,
}
COMPARISONS: dict[str, Callable[[Column, Column], Column]] = {
    ">=": lambda a, b: a >= b,
    "<=": lambda a, b: a <= b,
    "<>": lambda a, b: a != b,
    "!=": lambda a, b: a != b,
    ">": lambda a, b: a > b,
    "<": lambda a, b: a < b,
    "=": lambda a, b: a == b,
}


@dataclass(frozen=True)
class Level:
    name: str
    column: str
    order: int


@dataclass(frozen=True)
class Dimension:
    name: str
    column: str
    kind: str = "categorical"
    levels: tuple[Level, ...] = ()

    def ordered_levels(self) -> list[Level]:
        return sorted(self.levels, key=lambda level: level.order)

    def down_to(self, name: str) -> list[Level]:
        """The levels from the coarsest to the named one."""
        levels = self.ordered_levels()
        for at, level in enumerate(levels):
            if level.name == name:
                return levels[: at + 1]
        raise ValueError(f"dimension {self.name} has no level {name}")


@dataclass(frozen=True)
class Measure:
    name: str
    column: str
    aggregation: str

    def expression(self) -> Column:
        if self.aggregation not in AGGREGATIONS:
            raise ValueError(f"unknown aggregation {self.aggregation}")
        if self.column == "*":
            return F.count(F.lit(1)).alias(self.name)
        return AGGREGATIONS[self.aggregation](self.column).alias(self.name)


@dataclass(frozen=True)
class CubeSchema:
    name: str
    dimensions: tuple[Dimension, ...]
    measures: tuple[Measure, ...]

    def dimension(self, name: str) -> Dimension:
        return _named(self.dimensions, name, "dimension")

    def measure(self, name: str) -> Measure:
        return _named(self.measures, name, "measure")


def _named(items, name: str, kind: str):
    for item in items:
        if item.name == name:
            return item
    raise ValueError(f"unknown {kind} {name}")


@dataclass(frozen=True)
class CubeQuery:
    dimensions: tuple[str, ...] = ()
    measures: tuple[str, ...] = ()
    filters: dict[str, Any] = field(default_factory=dict)
    having: dict[str, str] = field(default_factory=dict)
    order_by: tuple[str, ...] = ()
    limit: int | None = None
    shown_level: dict[str, str] = field(default_factory=dict)


class Cube:
    def __init__(self, source: DataFrame, schema: CubeSchema):
        self.source = source
        self.schema = schema

    def query(self, query: CubeQuery) -> DataFrame:
        groups = [column for name in query.dimensions for column in self._group_columns(name, query)]
        measures = [self.schema.measure(name).expression() for name in query.measures]
        rows = self.source
        for name, wanted in query.filters.items():
            rows = rows.filter(self._filter(name, wanted))
        if measures:
            result = rows.groupBy(*groups).agg(*measures)
        elif groups:
            result = rows.select(*groups).distinct()
        else:
            raise ValueError("a cube query needs a dimension or a measure")
        for name, condition in query.having.items():
            result = result.filter(having_condition(F.col(name), condition))
        if query.order_by:
            result = result.orderBy(*[part for text in query.order_by for part in self._order(text, query)])
        return result if query.limit is None else result.limit(query.limit)

    def dimension_values(self, name: str) -> DataFrame:
        """Distinct non-null values of a dimension, sorted."""
        column = F.col(self.schema.dimension(name).column).alias(name)
        return self.source.select(column).filter(F.col(name).isNotNull()).distinct().orderBy(name)

    def _group_columns(self, name: str, query: CubeQuery) -> list[Column]:
        dimension = self.schema.dimension(name)
        if name in query.shown_level:
            return [F.col(level.column).alias(level.name) for level in dimension.down_to(query.shown_level[name])]
        return [F.col(dimension.column).alias(name)]

    def _order(self, text: str, query: CubeQuery) -> list[Column]:
        """`name` or `name desc`; a hierarchy orders by each of its shown levels."""
        name, _, direction = text.partition(" ")
        names = [name]
        if name in query.shown_level:
            names = [level.name for level in self.schema.dimension(name).down_to(query.shown_level[name])]
        falling = direction.strip().lower() == "desc"
        return [F.col(n).desc() if falling else F.col(n).asc() for n in names]

    def _filter(self, name: str, wanted: Any) -> Column:
        dimension = next((d for d in self.schema.dimensions if d.name == name), None)
        levels = {level.name: level.column for d in self.schema.dimensions for level in d.levels}
        if dimension is None and name not in levels:
            raise ValueError(f"unknown dimension {name}")
        column = F.col(dimension.column if dimension else levels[name])
        if isinstance(wanted, (list, tuple, set)):
            return column.isin(list(wanted)) if wanted else F.lit(False)
        return column == F.lit(wanted)


def having_condition(column: Column, condition: str) -> Column:
    """A comparison with one number or quoted text, such as `> 100`."""
    match = re.fullmatch(r"\s*(>=|<=|<>|!=|>|<|=)\s*(?:(-?\d+(?:\.\d+)?)|'([^']*)')\s*", condition)
    if match is None:
        raise ValueError(f"not a having condition: {condition}")
    operator, number, text = match.groups()
    if number is None:
        value = text
    else:
        value = float(number) if "." in number else int(number)
    return COMPARISONS[operator](column, F.lit(value))


Operation = Callable[[CubeQuery], CubeQuery]


def slice_by(dimension: str, value: Any) -> Operation:
    """Fix a dimension to a value and drop it from the result."""
    return lambda query: replace(
        query,
        dimensions=tuple(name for name in query.dimensions if name != dimension),
        filters=query.filters | {dimension: value},
    )


def dice(filters: dict[str, Any]) -> Operation:
    """Add equality or list filters; the dimensions stay."""
    return lambda query: replace(query, filters=query.filters | filters)


filter_by = dice


def drill_to(dimension: str, level: str) -> Operation:
    """Show a hierarchy down to `level`: towards a finer level to drill down, a coarser one to drill up."""

    def apply(query: CubeQuery) -> CubeQuery:
        names = query.dimensions if dimension in query.dimensions else (*query.dimensions, dimension)
        return replace(query, dimensions=names, shown_level=query.shown_level | {dimension: level})

    return apply


drill_down = drill_up = drill_to


def reorder(rows: list[str], columns: list[str]) -> Operation:
    """Pivot in long form: row dimensions first, then column dimensions."""
    return lambda query: replace(query, dimensions=(*rows, *columns))


def roll_up(dimension: str) -> Operation:
    """Remove a dimension and any filter on it."""
    return lambda query: replace(
        query,
        dimensions=tuple(name for name in query.dimensions if name != dimension),
        filters={name: value for name, value in query.filters.items() if name != dimension},
    )


def top_n(measure: str, n: int, ascending: bool = False) -> Operation:
    """The n groups with the largest (or smallest) measure; ties go by the dimensions."""

    def apply(query: CubeQuery) -> CubeQuery:
        order = (measure if ascending else f"{measure} desc", *query.dimensions)
        measures = query.measures if measure in query.measures else (*query.measures, measure)
        return replace(query, measures=measures, order_by=order, limit=n)

    return apply


def in_sequence(*operations: Operation) -> Operation:
    def apply(query: CubeQuery) -> CubeQuery:
        for operation in operations:
            query = operation(query)
        return query

    return apply


def pivot_wide(result: DataFrame, rows: list[str], column: str, values: list[Any], measure: str) -> DataFrame:
    """A cube result in wide form. The values are given, which spares a job to find them.

    A pair of rows and column must hold one cell, and every cell must lie in a given column: a result with more
    dimensions, or a value that was not given, is an error when the rows are made rather than a lost cell.
    """
    listed = F.col(column).isin(values) | F.lit(None in values) & F.col(column).isNull()
    lost = F.raise_error(F.concat(F.lit(f"no column for {column} = "), F.coalesce(F.col(column).cast("string"), F.lit("null"))))
    checked = result.withColumn(column, F.when(F.coalesce(listed, F.lit(False)), F.col(column)).otherwise(lost.cast(result.schema[column].dataType)))
    several = F.raise_error(F.lit(f"several cells of {measure} for one {column}")).cast(result.schema[measure].dataType)
    return checked.groupBy(*rows).pivot(column, values).agg(F.when(F.count(F.lit(1)) <= 1, F.first(measure)).otherwise(several))


def measure_summary(result: DataFrame, measure: str) -> DataFrame:
    """Count, sum, min, max and average of a measure over the cells of a result."""
    return result.agg(
        F.count(measure).alias("count"),
        F.sum(measure).alias("sum"),
        F.min(measure).alias("min"),
        F.max(measure).alias("max"),
        F.avg(measure).alias("avg"),
    )


# What decides, by name and type, how a discovered column is used.
TEXT_TYPES = ("varchar", "char", "text", "string")
TIME_TYPES = ("date", "time", "timestamp")
NUMBER_TYPES = ("int", "float", "decimal", "numeric", "double")
DIMENSION_NAMES = ("id", "key", "code", "type")
AVERAGE_NAMES = ("avg", "average", "mean")
SUM_NAMES = ("count", "qty", "quantity", "amount", "total", "sum")


def discover_schema(df: DataFrame, name: str) -> CubeSchema:
    """Guess dimensions and measures from column types and names."""

    def has(text: str, parts: tuple[str, ...]) -> bool:
        return any(part in text for part in parts)

    dimensions, measures = [], []
    for column in df.schema.fields:
        kind, label = column.dataType.simpleString(), column.name.lower()
        if has(kind, TEXT_TYPES):
            dimensions.append(Dimension(column.name, column.name, "categorical"))
        elif has(kind, TIME_TYPES):
            dimensions.append(Dimension(column.name, column.name, "temporal"))
        elif has(kind, NUMBER_TYPES) and has(label, DIMENSION_NAMES):
            dimensions.append(Dimension(column.name, column.name, "numerical"))
        elif has(kind, NUMBER_TYPES):
            averaged = has(label, AVERAGE_NAMES) and not has(label, SUM_NAMES)
            measures.append(Measure(column.name, column.name, "avg" if averaged else "sum"))
    if not dimensions:
        raise ValueError(f"No suitable dimensions found in table {name}")
    if not measures:
        measures.append(Measure("record_count", "*", "count"))
    return CubeSchema(name, tuple(dimensions), tuple(measures))
