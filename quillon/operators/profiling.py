"""Table and column profiles.

Distinct values are counted per (column, value) in one shuffle. A long text travels as its
sha-256 digest and comes back only for the few values that are reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from quillon.functions.ordering import linear_quantile, quantiles
from quillon.sources.files import TEXT_TIMES

#: Characters of a text that travel with its digest.
START = 64


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def time_columns(df: DataFrame) -> list[str]:
    kinds = (T.TimestampType, T.TimestampNTZType, T.DateType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def text_columns(df: DataFrame) -> list[str]:
    kinds = (T.StringType, T.BooleanType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def value_digest(column: str) -> Column:
    return F.sha2(F.col(f"`{column}`").cast("string"), 256)


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, start, digest, n) for every distinct value, null included; `start` is the text's first characters."""
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.substring(F.col(f"`{c}`").cast("string"), 1, START).alias("start"), value_digest(c).alias("digest"))
            for c in columns or df.columns
        ]
    )
    return df.select(F.explode(pairs).alias("p")).select("p.*").groupBy("column", "start", "digest").agg(F.count(F.lit(1)).alias("n"))


def most_frequent(df: DataFrame, counted: DataFrame, columns: list[str], n: int) -> DataFrame:
    """(column, rank, value, n): the n most frequent values per column, ties by their text.

    The start of a text orders it among most others. Only values that can still be among the n best,
    equal starts counted as ties, are looked up whole. Ranking goes by hash parts first, so the distinct
    values of one column never meet in one task.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("n"), "start"]
    values = counted.filter(F.col("digest").isNotNull()).withColumn("_part", F.pmod(F.xxhash64("digest"), F.lit(parts)))
    able = (
        values.withColumn("rank", F.rank().over(Window.partitionBy("column", "_part").orderBy(*order)))
        .filter(F.col("rank") <= n)
        .withColumn("rank", F.rank().over(Window.partitionBy("column").orderBy(*order)))
        .filter(F.col("rank") <= n)
        .drop("_part", "rank")
    )
    long_text = [c for c in columns if isinstance(df.schema[c].dataType, T.StringType)]
    value = F.col("start")
    if long_text:
        texts = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("text")) for c in long_text])
        found = (
            df.select(F.explode(F.filter(texts, lambda p: F.length(p["text"]) > START)).alias("p"))
            .select("p.column", "p.text", F.sha2("p.text", 256).alias("digest"))
            .join(able.filter(F.length("start") == START).select("column", "digest"), ["column", "digest"], "left_semi")
            .groupBy("column", "digest")
            .agg(F.min("text").alias("_text"))
        )
        able = able.join(found, ["column", "digest"], "left")
        value = F.coalesce("_text", "start")
    ranked = able.withColumn("value", value).withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value")))
    return ranked.filter(F.col("rank") <= n).select("column", "rank", "value", "n")


def row_digest(df: DataFrame) -> Column:
    """Digest of a row by the full text of each value with its length, so that rows differ as their values do."""
    cells = []
    for field in df.schema.fields:
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.BinaryType):
            text = F.hex(value)
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            text = F.to_json(value, TEXT_TIMES)
        else:
            text = value.cast("string")
        cells.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat_ws(",", *cells), 256)


def table_profile(df: DataFrame) -> DataFrame:
    """Rows, columns, missing cells and duplicate rows, with percentages.

    A row is compared by its digest, so the shuffle carries no wide rows.
    """
    row = row_digest(df)
    missing = sum((F.col(f"`{c}`").isNull().cast("long") for c in df.columns), F.lit(0).cast("long"))
    groups = df.select(row.alias("row"), missing.alias("missing")).groupBy("row").agg(
        F.count(F.lit(1)).alias("n"), F.sum("missing").alias("missing")
    )
    width = len(df.columns)
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.lit(width).alias("column_count"),
        F.coalesce(F.sum("missing"), F.lit(0)).alias("missing_cells"),
        F.coalesce(F.try_divide(F.sum("missing") * 100.0, F.sum("n") * width), F.lit(0.0)).alias("missing_cells_percentage"),
        (F.coalesce(F.sum("n"), F.lit(0)) - F.count(F.lit(1))).alias("duplicate_rows"),
        F.coalesce(F.try_divide((F.sum("n") - F.count(F.lit(1))) * 100.0, F.sum("n")), F.lit(0.0)).alias(
            "duplicate_rows_percentage"
        ),
    )


def column_profile(df: DataFrame) -> DataFrame:
    """Per column: type, missing, unique, most frequent value (ties by its text)."""
    counted = value_counts(df)
    is_value = F.col("digest").isNotNull()
    summary = counted.groupBy("column").agg(
        F.sum("n").alias("row_count"),
        F.coalesce(F.sum(F.when(~is_value, F.col("n"))), F.lit(0)).alias("missing_count"),
        F.count("digest").alias("unique_count"),
    )
    best = most_frequent(df, counted, df.columns, 1).select("column", "value", F.col("n").alias("most_frequent_count"))
    types = {field.name: field.dataType.simpleString() for field in df.schema.fields}
    kind = F.create_map(*[F.lit(x) for pair in types.items() for x in pair])
    return summary.join(best, "column", "left").select(
        "column",
        kind[F.col("column")].alias("dtype"),
        "missing_count",
        (F.col("missing_count") * 100.0 / F.col("row_count")).alias("missing_percentage"),
        "unique_count",
        (F.col("unique_count") * 100.0 / F.col("row_count")).alias("unique_percentage"),
        F.col("value").alias("most_frequent_value"),
        "most_frequent_count",
        "row_count",
    )


def _per_column(wide: DataFrame, columns: list[str], names: list[str]) -> DataFrame:
    """Turn one row of `<name>__<column>` cells into a row per column."""
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("column"), *[F.col(f"`{name}__{c}`").alias(name) for name in names])
            for c in columns
        ]
    )
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def numeric_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Moments, quartiles, zeros, negatives and IQR outliers per numeric column.

    Moments are one pass over the table. Quartiles are exact and interpolated, from counted
    values. Skewness and kurtosis carry the small-sample correction.
    """
    columns = columns or numeric_columns(df)
    values = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    cells = []
    for c in columns:
        v = F.col(c)
        cells += [
            F.count(v).alias(f"count__{c}"),
            F.count(F.lit(1)).alias(f"row_count__{c}"),
            F.min(v).alias(f"min__{c}"),
            F.max(v).alias(f"max__{c}"),
            F.avg(v).alias(f"mean__{c}"),
            F.stddev_samp(v).alias(f"std__{c}"),
            F.var_samp(v).alias(f"variance__{c}"),
            F.skewness(v).alias(f"g1__{c}"),
            F.kurtosis(v).alias(f"g2__{c}"),
            F.count_if(v == 0).alias(f"zeros_count__{c}"),
            F.count_if(v < 0).alias(f"negative_count__{c}"),
        ]
    names = ["count", "row_count", "min", "max", "mean", "std", "variance", "g1", "g2", "zeros_count", "negative_count"]
    moments = _per_column(values.agg(*cells), columns, names)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns])
    long_values = values.select(F.explode(pairs).alias("p")).select("p.*")
    shares = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    quartiles = quantiles(long_values, ["column"], "value", {name: linear_quantile("value", share) for name, share in shares.items()})
    # The fences of all columns become one row, so the outliers are one more wide aggregation.
    spread = F.col("q3") - F.col("q1")
    fence = lambda c, value: F.max(F.when(F.col("column") == c, value))
    fences = quartiles.agg(
        F.struct(
            *[fence(c, F.col("q1") - 1.5 * spread).alias(f"low__{c}") for c in columns],
            *[fence(c, F.col("q3") + 1.5 * spread).alias(f"high__{c}") for c in columns],
        )
    ).scalar()
    outside = lambda c: (F.col(c) < F.col("_fences").getField(f"low__{c}")) | (F.col(c) > F.col("_fences").getField(f"high__{c}"))
    outliers = _per_column(
        values.withColumn("_fences", fences).agg(*[F.count_if(outside(c)).alias(f"outliers_count__{c}") for c in columns]),
        columns,
        ["outliers_count"],
    )
    n = F.col("count").cast("double")
    share = lambda name: F.try_divide(F.col(name) * 100.0, F.col("row_count"))
    return (
        moments.join(quartiles, "column", "left")
        .join(outliers, "column", "left")
        .select(
            "column", "count", "min", "max", "mean", "median", "std", "variance",
            F.when(n > 2, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2)).alias("skewness"),
            F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6)).alias("kurtosis"),
            "q1", "q3",
            (F.col("q3") - F.col("q1")).alias("iqr"),
            "zeros_count",
            share("zeros_count").alias("zeros_percentage"),
            "negative_count",
            share("negative_count").alias("negative_percentage"),
            "outliers_count",
            share("outliers_count").alias("outliers_percentage"),
        )
    )


def time_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Min, max and whole elapsed days per time column."""
    columns = columns or time_columns(df)
    wide = df.agg(
        *[
            cell
            for c in columns
            for cell in (
                F.min(F.col(c).cast("timestamp_ntz")).alias(f"min__{c}"),
                F.max(F.col(c).cast("timestamp_ntz")).alias(f"max__{c}"),
            )
        ]
    )
    elapsed = F.unix_micros(F.col("max").cast("timestamp")) - F.unix_micros(F.col("min").cast("timestamp"))
    return _per_column(wide, columns, ["min", "max"]).withColumn(
        "range_days", F.floor(elapsed / F.lit(86_400_000_000))
    )


def text_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Length statistics of the non-null values per text column."""
    columns = columns or text_columns(df)
    wide = df.agg(
        *[
            cell
            for c in columns
            for cell in (
                F.min(F.length(F.col(c).cast("string"))).cast("long").alias(f"min_length__{c}"),
                F.max(F.length(F.col(c).cast("string"))).cast("long").alias(f"max_length__{c}"),
                F.avg(F.length(F.col(c).cast("string"))).alias(f"avg_length__{c}"),
            )
        ]
    )
    return _per_column(wide, columns, ["min_length", "max_length", "avg_length"])


def top_categories(df: DataFrame, columns: list[str] | None = None, n: int = 10) -> DataFrame:
    """The n most frequent values per text column, with rank; ties go by the value."""
    columns = columns or text_columns(df)
    best = most_frequent(df, value_counts(df, columns), columns, n)
    return best.select("column", "rank", "value", F.col("n").alias("count"))


def correlations(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pearson correlation of every pair of numeric columns, over the rows where both are set."""
    columns = columns or numeric_columns(df)
    pairs = [(a, b) for at, a in enumerate(columns) for b in columns[at + 1 :]]
    values = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    cells = []
    for a, b in pairs:
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        cells.append(F.corr(F.when(both, F.col(a)), F.when(both, F.col(b))).alias(f"{a}__{b}"))
    rows = F.array(
        *[
            F.struct(F.lit(a).alias("column1"), F.lit(b).alias("column2"), F.col(f"{a}__{b}").alias("correlation"))
            for a, b in pairs
        ]
    )
    return values.agg(*cells).select(F.explode(rows).alias("r")).select("r.*")


def high_correlations(matrix: DataFrame, threshold: float = 0.8) -> DataFrame:
    return matrix.filter(F.abs("correlation") >= threshold).orderBy(F.desc(F.abs("correlation")), "column1", "column2")


def profile_warnings(table: DataFrame, columns: DataFrame) -> DataFrame:
    """Warning rows (kind, column, value) from a table profile and a column profile."""
    whole = F.array_compact(
        F.array(
            F.when(F.col("missing_cells_percentage") > 2, F.struct(F.lit("high_missing").alias("kind"), F.col("missing_cells_percentage").alias("value"))),
            F.when(F.col("duplicate_rows_percentage") > 5, F.struct(F.lit("high_duplicates").alias("kind"), F.col("duplicate_rows_percentage").alias("value"))),
        )
    )
    table_rows = table.select(F.explode(whole).alias("w")).select("w.kind", F.lit(None).cast("string").alias("column"), "w.value")

    def flag(test: Column, kind: str) -> Column:
        return F.when(test, F.lit(kind))

    flags = F.array_compact(
        F.array(
            flag(F.col("missing_count") == F.col("row_count"), "all_missing"),
            flag(F.col("unique_count") == 1, "single_value"),
            flag((F.col("unique_count") > 0.9 * F.col("row_count")) & (F.col("row_count") > 100), "high_cardinality"),
        )
    )
    column_rows = columns.select("column", F.col("unique_count").cast("double").alias("value"), F.explode(flags).alias("kind"))
    return table_rows.unionByName(column_rows)


def compare_columns(first: DataFrame, second: DataFrame, threshold: float = 5.0) -> DataFrame:
    """Column profiles side by side: changes, new and removed columns, and a warning flag."""
    fields = ["missing_percentage", "unique_percentage"]
    a = first.select("column", F.lit(True).alias("_a"), *[F.col(f).alias(f"_a_{f}") for f in fields])
    b = second.select("column", F.lit(True).alias("_b"), *[F.col(f).alias(f"_b_{f}") for f in fields])
    change = lambda f: F.col(f"_b_{f}") - F.col(f"_a_{f}")
    status = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "removed").otherwise("common")
    return a.join(b, "column", "full").select(
        "column",
        status.alias("status"),
        change("missing_percentage").alias("missing_percentage_change"),
        change("unique_percentage").alias("unique_percentage_change"),
        F.coalesce((status != "common") | (F.abs(change("missing_percentage")) > threshold), F.lit(True)).alias("warned"),
    )


def compare_tables(first: DataFrame, second: DataFrame) -> DataFrame:
    """Differences of two table profiles (one row each)."""
    fields = ["row_count", "column_count", "missing_cells_percentage", "duplicate_rows_percentage"]
    sides = first.select(F.lit(-1).alias("sign"), *fields).unionAll(second.select(F.lit(1).alias("sign"), *fields))
    return sides.agg(*[F.sum(F.col(f) * F.col("sign")).alias(f"{f}_change") for f in fields])


def input_quality(df: DataFrame, missing_limit: float = 0.1, outlier_limit: float = 0.05) -> DataFrame:
    """Model-input check: missing share, outlier share and issue flags per column."""
    shares = df.agg(*[F.avg(F.col(f"`{c}`").isNull().cast("double")).alias(f"missing_share__{c}") for c in df.columns])
    missing = _per_column(shares, df.columns, ["missing_share"])
    outlier = numeric_profile(df).select("column", (F.col("outliers_percentage") / 100.0).alias("outlier_share"))
    return missing.join(outlier, "column", "left").select(
        "column",
        "missing_share",
        "outlier_share",
        (F.col("missing_share") > missing_limit).alias("high_missing"),
        F.coalesce(F.col("outlier_share") > outlier_limit, F.lit(False)).alias("high_outliers"),
    )


def quality_score(columns: DataFrame) -> DataFrame:
    """Mean of the two complements: missing share over all columns, outlier share over numeric ones."""
    return columns.agg(
        (((1 - F.avg("missing_share")) + (1 - F.coalesce(F.avg("outlier_share"), F.lit(0.0)))) / 2).alias("overall_score")
    )
