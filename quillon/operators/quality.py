"""Expectation suites. All scalar checks of a suite share one aggregation pass."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, functions as F

RESULT = "check_no int, expectation_type string, column string, success boolean, observed double, detail string"


def common_expectations(
    columns: list[str],
    primary_key_columns: list[str] | None = None,
    not_null_columns: list[str] | None = None,
    unique_columns: list[str] | None = None,
) -> list[dict[str, Any]]:
    """The usual suite for a table: column order, at least one row, each column, keys."""

    def per_column(kind: str, names: list[str] | None) -> list[dict[str, Any]]:
        return [{"expectation_type": kind, "kwargs": {"column": name}} for name in names or []]

    keys = [
        {"expectation_type": kind, "kwargs": {"column": name}}
        for name in primary_key_columns or []
        for kind in ("expect_column_values_to_not_be_null", "expect_column_values_to_be_unique")
    ]
    return [
        {"expectation_type": "expect_table_columns_to_match_ordered_list", "kwargs": {"column_list": columns}},
        {"expectation_type": "expect_table_row_count_to_be_between", "kwargs": {"min_value": 1}},
        *per_column("expect_column_to_exist", columns),
        *keys,
        *per_column("expect_column_values_to_not_be_null", not_null_columns),
        *per_column("expect_column_values_to_be_unique", unique_columns),
    ]


def run_suite(df: DataFrame, expectations: list[dict[str, Any]]) -> DataFrame:
    """One row per expectation: success, an observed number and a detail text.

    `observed` is the row count, null count, duplicate count or count of unexpected values.
    """
    needed, rows = _planned(df, expectations)
    return _judged(df.agg(*[expression.alias(f"_{name}") for name, expression in needed.items()]), rows)


def observed_suite(df: DataFrame, expectations: list[dict[str, Any]]) -> tuple[DataFrame, Callable[[DataFrame], tuple[DataFrame, int]]]:
    """`df` whose next write also counts what the suite needs, and a function to call after it.

    That function takes the written table and returns the result rows of run_suite and the number of rows. Only the
    distinct counts of uniqueness checks, which cannot be observed in passing, are read from the written table.
    """
    needed, rows = _planned(df, expectations)
    passing = {name: expression for name, expression in needed.items() if not name.startswith("distinct_")}
    seen = Observation()

    def results(written: DataFrame) -> tuple[DataFrame, int]:
        values = {name: seen.get[f"_{name}"] for name in passing}
        later = [expression.alias(name) for name, expression in needed.items() if name not in passing]
        values |= written.agg(*later).first().asDict() if later else {}
        counted = df.sparkSession.createDataFrame([tuple(values[name] for name in needed)], ", ".join(f"`_{name}` long" for name in needed))
        return _judged(counted, rows), values["rows"]

    return df.observe(seen, *[expression.alias(f"_{name}") for name, expression in passing.items()]), results


def _planned(df: DataFrame, expectations: list[dict[str, Any]]) -> tuple[dict[str, Column], Column]:
    """The aggregations that a suite needs, and its result rows as an array over them."""
    # Casting a count to double inside the struct keeps one result type for all checks.
    needed: dict[str, Column] = {"rows": F.count(F.lit(1))}
    plans = []
    for at, expectation in enumerate(expectations):
        plans.append(_plan(df, at, expectation["expectation_type"], expectation.get("kwargs", {}), needed))
    rows = F.array(
        *[
            F.struct(
                F.lit(at).alias("check_no"),
                F.lit(expectation["expectation_type"]).alias("expectation_type"),
                F.lit(expectation.get("kwargs", {}).get("column")).cast("string").alias("column"),
                success.alias("success"),
                observed.cast("double").alias("observed"),
                detail.cast("string").alias("detail"),
            )
            for at, (expectation, (success, observed, detail)) in enumerate(zip(expectations, plans))
        ]
    )
    return needed, rows


def _judged(counted: DataFrame, rows: Column) -> DataFrame:
    return counted.select(F.explode(rows).alias("r")).select("r.*")


def _plan(df: DataFrame, at: int, kind: str, kwargs: dict[str, Any], needed: dict[str, Column]):
    nothing = F.lit(None)
    column = kwargs.get("column")
    total = F.col("_rows")
    if kind == "expect_table_row_count_to_be_between":
        low, high = kwargs.get("min_value", 0), kwargs.get("max_value")
        success = (total >= low) if high is None else total.between(low, high)
        return success, total, nothing
    if kind == "expect_column_to_exist":
        found = column in df.columns
        return F.lit(found), F.lit(int(found)), nothing
    if kind == "expect_table_columns_to_match_ordered_list":
        return F.lit(kwargs.get("column_list", []) == df.columns), F.lit(len(df.columns)), F.lit(",".join(df.columns))
    if column is not None and column not in df.columns:
        return F.lit(False), nothing, F.lit(f"there is no column {column}")
    if kind == "expect_column_values_to_not_be_null":
        needed[f"null_{column}"] = F.count_if(F.col(column).isNull())
        nulls = F.col(f"_null_{column}")
        return nulls == 0, nulls, F.format_number(F.try_divide(nulls * 100.0, total), 4)
    if kind == "expect_column_values_to_be_unique":
        needed[f"null_{column}"] = F.count_if(F.col(column).isNull())
        needed[f"distinct_{column}"] = F.count_distinct(column)
        null_value = (F.col(f"_null_{column}") > 0).cast("long")
        duplicates = total - F.col(f"_distinct_{column}") - null_value
        return duplicates == 0, duplicates, nothing
    if kind in ("expect_column_values_to_be_between", "expect_column_values_to_be_in_set"):
        value = F.col(column)
        if kind.endswith("between"):
            bad = F.lit(False)
            if kwargs.get("min_value") is not None:
                bad = bad | (value < kwargs["min_value"])
            if kwargs.get("max_value") is not None:
                bad = bad | (value > kwargs["max_value"])
        else:
            bad = ~value.isin(list(kwargs["value_set"])) if kwargs["value_set"] else value.isNotNull()
        needed[f"bad_{at}"] = F.count_if(bad)
        unexpected = F.col(f"_bad_{at}")
        return unexpected == 0, unexpected, nothing
    return F.lit(False), nothing, F.lit(f"no such expectation: {kind}")


def suite_summary(results: DataFrame, dataset: str) -> DataFrame:
    """Totals over the result rows of a suite; `success_rate` is a fraction."""
    passed = F.count_if("success")
    total = F.count(F.lit(1))
    return results.agg(
        F.lit(dataset).alias("dataset_name"),
        total.alias("expectations_count"),
        passed.alias("success_count"),
        (total - passed).alias("failure_count"),
        F.coalesce(F.try_divide(passed.cast("double"), total), F.lit(0.0)).alias("success_rate"),
        (total == passed).alias("success"),
        F.array_sort(F.collect_set(F.when(~F.col("success"), F.col("expectation_type")))).alias("failed_types"),
    )
