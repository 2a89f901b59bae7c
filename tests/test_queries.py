"""Registered queries next to their SQL on the smallest data folder; all of them when CHECK_ALL is set."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_queries import TABLES, compare

FOLDER = "/root/testdata/sf0.001"
SAMPLE = (
    "mmwr_year_length", "dense_grid", "weekly_grid", "header_row_detect", "alias_resolution", "typed_rows", "date_convention_parse",
    "unpivot_years", "matrix_expand", "duplicate_keys", "readiness", "quality_report", "calendar_lags", "acf", "backtest",
    "rolling_backtest", "seasonal_naive", "candidate_search", "mape_profile", "projected_rank_with_error", "dataset_state", "latest_run",
    "content_signature", "report_document", "stream_rollup", "apply_decisions", "run_upsert", "change_token",
)

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()) if os.environ.get("CHECK_ALL") else SAMPLE)
def test_query_equals_its_sql(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    result = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert compare(df.columns, [tuple(r) for r in df.collect()], columns, result.fetchall()) is None


def test_every_statement_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert [r["rank"] for r in sorted(rows, key=lambda r: -r["projected_total"])] == list(range(1, len(rows) + 1)) and len(rows) == 5
