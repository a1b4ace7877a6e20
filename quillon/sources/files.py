"""File and database endpoints chosen by suffix, as Spark readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import types as T

# Spark's own text form of a time stops at milliseconds.
TEXT_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
FORMATS = {".csv": "csv", ".parquet": "parquet", ".json": "json"}


def format_of(location: str) -> str:
    for suffix, name in FORMATS.items():
        if location.endswith(suffix):
            return name
    raise ValueError(f"Unsupported file format: {location}")


def read_file(spark: SparkSession, location: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Read csv, parquet or json by suffix. Give a schema to spare the inference pass."""
    kind = format_of(location)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if kind == "csv":
        return reader.csv(location, header=True, inferSchema=schema is None)
    return getattr(reader, kind)(location)


def write_file(df: DataFrame, location: str, mode: str = "errorifexists") -> None:
    """Write csv, parquet or json lines by suffix; the location becomes a folder of parts."""
    kind = format_of(location)
    writer = df.write.mode(mode)
    if kind == "parquet":
        writer.parquet(location)
    elif kind == "csv":
        writer.options(**TEXT_TIMES).csv(location, header=True)
    else:
        writer.options(**TEXT_TIMES).json(location)


def write_report(tables: dict[str, DataFrame], folder: str, kind: str = "csv", mode: str = "errorifexists") -> None:
    """One csv or json output per report table."""
    if kind not in ("csv", "json"):
        raise ValueError(f"Unsupported report format: {kind}")
    for name, table in tables.items():
        write_file(table, f"{folder.rstrip('/')}/{name}.{kind}", mode)


def jdbc_options(
    url: str,
    query: str,
    user: str | None = None,
    password: str | None = None,
    driver: str | None = None,
    fetch_size: int = 10000,
    split_column: str | None = None,
    split_range: tuple[int, int] | None = None,
    splits: int = 1,
) -> dict[str, str]:
    """Options of the jdbc format for a query; with a split column the read is parallel."""
    options = {"url": url, "fetchsize": str(fetch_size)}
    if split_column:
        if split_range is None:
            raise ValueError("split_column needs split_range")
        options |= {
            "dbtable": f"({query}) AS source",
            "partitionColumn": split_column,
            "lowerBound": str(split_range[0]),
            "upperBound": str(split_range[1]),
            "numPartitions": str(splits),
        }
    else:
        options["query"] = query
    for name, value in (("user", user), ("password", password), ("driver", driver)):
        if value is not None:
            options[name] = value
    return options


def database_reader(spark: SparkSession, **options) -> DataFrameReader:
    return spark.read.format("jdbc").options(**jdbc_options(**options))
