"""A fast subset of registered queries against their DuckDB oracles at sf0.001."""

import duckdb
import pytest

import __spark_entry__ as E
from tools.check_oracle import TABLES, rows_of

SF = "/root/testdata/sf0.001"
SUBSET = [
    "rain_rate_by_hour",
    "to_numeric",
    "fill_interpolate",
    "fill_backward",
    "lag_features",
    "rolling_std",
    "build_timestamp",
    "scenario_features",
    "describe",
    "correlation_matrix",
    "histogram_by_class",
    "box_stats_by_class",
    "label_encode_apply",
    "roc_auc",
    "kfold",
    "stratified_split",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_registry_has_oracles_for_most():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(o) >= 90


@pytest.mark.parametrize("name", SUBSET)
def test_matches_duckdb(spark, con, name):
    df = E.queries()[name](spark, SF)
    cur = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(dcols)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(dcols, cur.fetchall())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "rate" in df.columns
