"""Observation-shaped views derived from the supplied tables, written once for both engines.

The supplied tables are not weather files; these deterministic derivations turn
``events`` into station observations (station = ``user_id``, order = ``(ts, event_id)``)
and add missing data in fixed patterns.  Each view is an expression list valid in both
Spark SQL and DuckDB, so the Spark query and its SQL oracle read identical inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# (name, expression) over ``events``; every measure is a plain IEEE expression of value / event_id
OBS_BASE = [
    ("event_id", "event_id"),
    ("station_id", "user_id"),
    ("ts", "ts"),
    ("event_type", "event_type"),
    ("rain_mm", "CASE WHEN value > 60 THEN (value - 60) / 10 ELSE CAST(0 AS DOUBLE) END"),
    ("temp", "15 + value / 20"),
    ("humidity", "CAST(40 + (event_id * 13) % 60 AS DOUBLE)"),
    ("pressure", "1000 + CAST(event_id % 30 AS DOUBLE) / 2"),
    ("radiation", "CAST((event_id * 7) % 3000 AS DOUBLE)"),
    ("wind_speed", "CAST(event_id % 50 AS DOUBLE) / 10"),
]
OBS_DERIVED = [
    ("temp_max", "temp + CAST(event_id % 5 AS DOUBLE) / 10"),
    ("temp_min", "temp - CAST(event_id % 3 AS DOUBLE) / 10"),
    ("dew_point", "temp - CAST(event_id % 7 AS DOUBLE)"),
    ("humidity_max", "humidity + CAST(event_id % 4 AS DOUBLE)"),
    ("humidity_min", "humidity - CAST(event_id % 6 AS DOUBLE)"),
    ("pressure_max", "pressure + CAST(event_id % 3 AS DOUBLE) / 2"),
    ("pressure_min", "pressure - CAST(event_id % 4 AS DOUBLE) / 4"),
]
# gaps: short runs (id % 7 in 0,1), a long-run pattern, sparse holes
GAPPY = [
    ("temp", "CASE WHEN event_id % 7 IN (0, 1) THEN NULL ELSE temp END"),
    ("humidity", "CASE WHEN event_id % 400 < 60 THEN NULL ELSE humidity END"),
    ("pressure", "CASE WHEN event_id % 11 = 0 THEN NULL ELSE pressure END"),
    ("rain_mm", "CASE WHEN event_id % 13 = 0 THEN NULL ELSE rain_mm END"),
    ("radiation", "CASE WHEN event_id % 5 < 3 THEN NULL ELSE radiation END"),
]
OBS_COLUMNS = [n for n, _ in OBS_BASE] + [n for n, _ in OBS_DERIVED]
# score table without a model: probability from the id, truth from the value
SCORES = [
    ("event_id", "event_id"),
    ("y_true", "CAST(CASE WHEN value > 60 THEN 1 ELSE 0 END AS INT)"),
    ("prob", "CAST((event_id * 37) % 1000 AS DOUBLE) / 1000"),
    ("y_pred", "CAST(CASE WHEN CAST((event_id * 37) % 1000 AS DOUBLE) / 1000 >= 0.5 THEN 1 ELSE 0 END AS INT)"),
    ("amount", "value"),
    ("amount_pred", "value * 0.9 + CAST(event_id % 10 AS DOUBLE)"),
]


def _select(exprs):
    return ", ".join(f"{e} AS {n}" for n, e in exprs)


def obs_sql() -> str:
    """``obs`` as a SQL subquery over ``events``."""
    return f"(SELECT *, {_select(OBS_DERIVED)} FROM (SELECT {_select(OBS_BASE)} FROM events) obs0)"


def gappy_sql() -> str:
    keep = [c for c in OBS_COLUMNS if c not in dict(GAPPY)]
    return f"(SELECT {', '.join(keep)}, {_select(GAPPY)} FROM {obs_sql()} o)"


def scores_sql() -> str:
    return f"(SELECT {_select(SCORES)} FROM events)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.selectExpr(*[f"{e} AS {n}" for n, e in OBS_BASE]).selectExpr("*", *[f"{e} AS {n}" for n, e in OBS_DERIVED])


def gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = obs(spark, sf_dir)
    gaps = dict(GAPPY)
    return o.selectExpr(*[c for c in OBS_COLUMNS if c not in gaps], *[f"{e} AS {n}" for n, e in GAPPY])


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*[f"{e} AS {n}" for n, e in SCORES])
