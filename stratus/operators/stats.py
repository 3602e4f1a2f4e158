"""Shared statistics helpers.

Table-wide statistics (mean, std, median, min/max) are single-row aggregates.  They are
attached to rows as *scalar subqueries* (``DataFrame.scalar()``): Spark evaluates each
aggregate once, merges subqueries over the same input into one job
(``MergeScalarSubqueries``) and inlines the values as literals — no cross join, no
driver round trip, and the size of what is shipped is one row by construction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] | list[str] = ()) -> list[str]:
    """Numeric columns in schema order (booleans and temporals excluded)."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES) and f.name not in exclude]


def column_stat(df: DataFrame, agg: Column) -> Column:
    """A one-row aggregate over ``df`` usable as a column expression on any DataFrame."""
    return df.select(agg).scalar()
