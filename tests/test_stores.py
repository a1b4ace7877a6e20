"""Retention that rewrites one day only, and checks that ride on the one write."""

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillon.operators import features
from quillon.operators.ingestion import ingest
from quillon.operators.quality import observed_suite, run_suite
from quillon.session import stored_for_a_while


def day(n, hour=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n, hours=hour)


def files(folder):
    return {str(p.relative_to(folder)): (p.stat().st_mtime_ns, p.stat().st_ino) for p in Path(folder).rglob("*.parquet")}


def test_retention_touches_only_what_expired(spark, tmp_path):
    rows = [(i * 10 + h, day(i, h)) for i in range(20) for h in (0, 6, 12, 18)] + [(999, None)]
    store = str(tmp_path / "store")
    features.stored_by_day(spark.createDataFrame(rows, "id int, created_at timestamp"), store)
    before = files(store)
    # The limit is day 10 at noon: forty values of ten days go, and two of the eleventh.
    assert features.apply_retention(spark, store, "2024-01-21 12:00:00", 10) == 42
    kept = {r[0] for r in spark.read.parquet(store).select("id").collect()}
    assert kept == {i for i, at in rows if at is None or at >= day(10, 12)}
    after = files(store)
    own = lambda names, keep: {n: v for n, v in names.items() if keep(n.split("/")[0])}
    later = lambda name: name > "day=2024-01-11" or "DEFAULT" in name
    assert own(after, later) == own(before, later) and len(own(after, later)) >= 10
    assert {n.split("/")[0] for n in after} == {f"day={day(i).date()}" for i in range(10, 20)} | {"day=__HIVE_DEFAULT_PARTITION__"}
    # Again: nothing is left to remove. With a limit at midnight the day before goes whole.
    assert features.apply_retention(spark, store, "2024-01-21 12:00:00", 10) == 0
    assert features.apply_retention(spark, store, "2024-01-22 00:00:00", 10) == 2
    assert features.apply_retention(spark, store, "2030-01-01", 10) == 36
    assert [r["id"] for r in spark.read.parquet(store).collect()] == [999]


EXPECTATIONS = [
    {"expectation_type": kind, "kwargs": kwargs}
    for kind, kwargs in [
        ("expect_table_row_count_to_be_between", {"min_value": 1}), ("expect_column_to_exist", {"column": "id"}), ("expect_column_values_to_not_be_null", {"column": "v"}),
        ("expect_column_values_to_be_unique", {"column": "id"}), ("expect_column_values_to_be_between", {"column": "v", "min_value": 0, "max_value": 5}), ("expect_nothing", {}),
    ]
]


@pytest.mark.parametrize("n", [0, 1, 50])
def test_observed_checks_equal_the_suite(spark, n):
    df = spark.createDataFrame([(i % 40, None if i % 7 == 3 else i % 9) for i in range(n)], "id int, v int")
    watched, results = observed_suite(df, EXPECTATIONS)
    with stored_for_a_while(watched, "test") as written:
        found, rows = results(written)
        assert rows == n and found.collect() == run_suite(df, EXPECTATIONS).collect()


def test_ingestion_reads_the_source_once(spark, tmp_path, monkeypatch):
    """Every row of the source passes a counter once, whatever is checked."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    source = str(tmp_path / "in.parquet")
    spark.range(1000).withColumn("v", F.col("id") % 7).write.parquet(source)
    from quillon.operators import ingestion

    own = ingestion.read_file
    reads = lambda s, path, schema=None: own(s, path, schema).mapInArrow(counted, "id long, v long") if path == source else own(s, path, schema)
    monkeypatch.setattr(ingestion, "read_file", reads)
    done = ingest(spark, source, str(tmp_path / "out.parquet"), "numbers", EXPECTATIONS[:4])
    assert (done.status, done.rows, seen.value) == ("success", 1000, 1000)
    assert spark.read.parquet(str(tmp_path / "out.parquet")).count() == 1000


def test_a_failed_check_publishes_nothing(spark, tmp_path):
    source, target = str(tmp_path / "in.parquet"), tmp_path / "out.parquet"
    spark.range(10).withColumn("v", F.lit(9)).write.parquet(source)
    done = ingest(spark, source, str(target), "numbers", EXPECTATIONS, fail_on_error=True)
    assert done.status == "failed" and len(done.errors) == 1 and not target.exists()
