"""Registry binding each operator to the supplied tables, with its DuckDB oracle SQL.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLE[name] -> SQL``.  Spark results
pass through :func:`tidy` (doubles rounded half-up to 6 places, -0.0 folded to 0.0, small
integers widened to bigint); the SQL side applies the same rounding with :func:`R`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
DIGITS = 6
SCALE = float(10**DIGITS)


def tidy(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            x = c.cast("double")
            c = F.when(F.abs(x) < F.lit(1e12), F.floor(x * F.lit(SCALE) + F.lit(0.5)).cast("double") / F.lit(SCALE)).otherwise(x) + F.lit(0.0)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def R(expr: str) -> str:
    """SQL twin of the double rounding in :func:`tidy` (same IEEE steps in both engines,
    so ties such as ``x.xxxxxx5`` round alike)."""
    x = f"CAST({expr} AS DOUBLE)"
    return f"(CASE WHEN abs({x}) < 1e12 THEN floor({x} * {SCALE!r} + 0.5) / {SCALE!r} ELSE {x} END + 0.0)"


def query(name: str, sql: str | None = None):
    """Register ``fn`` under ``name``; ``sql`` is its oracle (omit for non-SQL operators)."""

    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return tidy(fn(spark, sf_dir))

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn

    return deco


def load_all() -> None:
    import importlib

    for mod in ("cleaning", "filling", "temporal", "windows", "profiling", "sampling", "learning", "io"):
        try:
            importlib.import_module(f"stratus.bindings.{mod}")
        except ModuleNotFoundError as e:
            if e.name != f"stratus.bindings.{mod}":
                raise
