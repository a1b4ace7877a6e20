"""One ingestion: load, check, profile, register lineage, store."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from quillon.operators.profiling import column_profile, table_profile
from quillon.operators.quality import common_expectations, observed_suite
from quillon.session import stored_for_a_while
from quillon.sources.files import read_file, write_file


@dataclass
class Ingested:
    status: str
    rows: int
    checks: list[dict] = field(default_factory=list)
    profile: DataFrame | None = None
    columns: DataFrame | None = None
    edges: DataFrame | None = None
    warnings: list[str] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)


def ingest(
    spark: SparkSession,
    source: str,
    target: str,
    dataset: str,
    expectations: list[dict] | None = None,
    fail_on_error: bool = False,
    with_profile: bool = True,
    mode: str = "overwrite",
    schema=None,
) -> Ingested:
    """Load a file, run its suite, profile it, note the lineage edge and write it to `target`.

    The source is read once: while it is written to the shared folder its rows and what the checks count are observed.
    Then it is published from there. With `fail_on_error` nothing is published when a check fails.
    """
    loaded = read_file(spark, source, schema)
    watched, results = observed_suite(loaded, expectations or common_expectations(loaded.columns))
    with stored_for_a_while(watched, "ingest") as df:
        suite, rows = results(df)
        # One row per expectation.
        checks = [row.asDict() for row in suite.collect()]
        done = Ingested("success", rows, checks)
        if not all(check["success"] for check in checks):
            if fail_on_error:
                done.status = "failed"
                done.errors.append(f"{sum(not check['success'] for check in checks)} checks failed, nothing was stored")
                return done
            done.warnings.append(f"{sum(not check['success'] for check in checks)} checks failed")
        write_file(df, target, mode)
    stored = read_file(spark, target, df.schema)
    if with_profile:
        done.profile, done.columns = table_profile(stored), column_profile(stored)
    done.edges = spark.createDataFrame(
        [(source, dataset, f"ingest_{dataset}")], "source string, target string, transformation string"
    )
    return done
