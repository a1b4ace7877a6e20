"""Every registered query with SQL against DuckDB at the smallest scale."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import check  # noqa: E402

from quillon.plans.catalogue import ORACLES, QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def db(sf):
    return check.oracle_session(sf)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf, db, name):
    df = QUERIES[name](spark, sf)
    answer = db.execute(ORACLES[name])
    columns = [c[0] for c in answer.description]
    assert check.compare(df.columns, df.collect(), columns, answer.fetchall()) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).collect()
