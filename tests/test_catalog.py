"""Every query against its SQL twin, and the shape of the physical plans."""

from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402
from check import TABLES, compare  # noqa: E402
from vitalspan.catalog import all_oracles, all_queries  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
    return connection


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, SF_DIR, name).startswith(("ok", "rows-only"))


def test_every_query_has_sql():
    assert set(all_queries()) == set(all_oracles())
    assert set(all_queries()) <= set(queries()) and set(all_oracles()) <= set(oracle_sql())


def test_entry_returns_rows(spark):
    assert entry(spark).count() > 0


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(queries()))
def test_plans_have_no_products(spark, name):
    text = plan(queries()[name](spark, SF_DIR))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(queries()["time_cutoff"](spark, SF_DIR))
    assert "GreaterThanOrEqual(ts,2024-01-10" in text
    read = text.split("ReadSchema:")[1].split("\n")[0]
    assert "props" not in read and "event_type" not in read


def test_no_window_over_raw_rows_of_a_key(spark):
    """Sessions are windows over pre-aggregated cells: the first exchange already holds (key, cell)."""
    text = plan(queries()["stage3_session_filter"](spark, SF_DIR))
    exchanges = [line for line in text.splitlines() if "Exchange hashpartitioning" in line]
    assert sum("_cell" in line for line in exchanges) >= 1
    assert "partial_max" in text
