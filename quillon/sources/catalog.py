"""Queries, samples and profiles over catalog tables and views."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

# Texts that a table name must not contain.
REFUSED = (";", "--", "/*", "*/", "drop", "delete", "update", "insert")
SAMPLE_LIMITS = (1, 10000)


def checked_identifier(name: str, kind: str = "identifier") -> str:
    """`name`, if it is dotted words of at most 128 characters in all, none of them holding a refused text."""
    well_formed = len(name) <= 128 and all(re.fullmatch(r"\w+", part, re.ASCII) for part in name.split("."))
    if not well_formed or any(text in name.lower() for text in REFUSED):
        raise ValueError(f"{name!r} cannot name a {kind}")
    return name


def run_query(spark: SparkSession, query: str, params: dict[str, object] | None = None) -> DataFrame:
    """SQL with named parameters (`:name`), bound by Spark rather than pasted in."""
    return spark.sql(query, args=params or {})


def sample_table(spark: SparkSession, table: str, schema: str | None = None, limit: int = 100) -> DataFrame:
    """Any `limit` rows of a table."""
    checked_identifier(table, "table name")
    if schema:
        checked_identifier(schema, "schema name")
    low, high = SAMPLE_LIMITS
    if not isinstance(limit, int) or isinstance(limit, bool) or not low <= limit <= high:
        raise ValueError(f"Limit must be an integer between {low} and {high}")
    return spark.table(f"{schema}.{table}" if schema else table).limit(limit)


def table_info(df: DataFrame) -> DataFrame:
    """One row per column: position, type, nullability and the row count of the table.

    The count is one metadata-sized aggregation; the column list comes from the schema.
    """
    columns = F.array(
        *[
            F.struct(
                F.lit(at).alias("position"),
                F.lit(field.name).alias("column"),
                F.lit(field.dataType.simpleString()).alias("data_type"),
                F.lit(field.nullable).alias("is_nullable"),
            )
            for at, field in enumerate(df.schema.fields, start=1)
        ]
    )
    counted = df.agg(F.count(F.lit(1)).alias("row_count"))
    return counted.select(F.explode(columns).alias("c"), "row_count").select("c.*", "row_count")
