"""Sorted value tables in buckets of about equal size, and exact quantiles from them.

A quantile of a whole column needs its values in order.  ``percentile`` keeps them all in one
task; here the values are counted (map-side combine), dealt into ranges by Spark's own sampled
bounds and written once.  Ranks are a running sum over the small bucket table plus a running sum
inside each bucket, so every step is spread and the result is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratus.session import shared_table

RANGE = "__range"


def range_buckets(df: DataFrame, *order: str | Column) -> DataFrame:
    """``df`` with ``RANGE``, a bucket number that does not decrease along ``order``; buckets have
    about equal numbers of rows.  Written to the shared folder: every reader sees the same bounds."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return shared_table(df.repartitionByRange(parts, *order).withColumn(RANGE, F.spark_partition_id()), "ranges")


def _hashable(df: DataFrame) -> list[Column]:
    return [F.col(f"`{f.name}`") for f in df.schema if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]


def with_positions(df: DataFrame, order: Sequence[str | Column], out: str, total: str) -> DataFrame:
    """``df`` with ``out``, each row's position (from 1) in one ``order`` over all rows, and ``total``, their number.

    Any type that sorts will do; NULLs come last, and ties follow a hash of the whole row.  Rows are dealt into
    ranges of equal size by Spark's sampled bounds, sorted and numbered there, and written once; the ranges'
    sizes, as many numbers as there are shuffle partitions, give the offsets.  So a value that many rows share
    is no task of its own; only rows equal in every column stay together.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = [F.col(o).asc_nulls_last() if isinstance(o, str) else o for o in order]
    ordered.append(F.xxhash64(*(_hashable(df) or [F.lit(0)])))
    dealt = df.repartitionByRange(parts, *ordered).sortWithinPartitions(*ordered)
    # the upper bits of this id are the range, the lower 33 the row's place in it
    placed = shared_table(dealt.withColumn("__id", F.monotonically_increasing_id()), "positions")
    in_range = F.shiftright("__id", 33)
    sizes = sorted(placed.groupBy(in_range.alias(RANGE)).agg(F.count(F.lit(1))).collect())
    starts, n = [], 0
    for number, size in sizes:
        starts.append((number, n))
        n += size
    offsets = spark.createDataFrame(starts, f"{RANGE} long, __o long")
    rows = placed.withColumn(RANGE, in_range).join(F.broadcast(offsets), RANGE)
    place = F.col("__o") + F.col("__id").bitwiseAND(F.lit(2**33 - 1)) + 1
    return rows.select(*[F.col(f"`{c}`") for c in df.columns], place.alias(out), F.lit(n).cast("long").alias(total))


def value_table(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``(*by, column, value, n)`` in range buckets: how often each column has each value, as double.

    NaN counts as NULL; the NULLs are one row per column (and group).  One pass over ``df``.
    """
    cells = [F.struct(F.lit(c).alias("column"), F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias("value")) for c in columns]
    counts = df.select(*by, F.inline(F.array(*cells))).groupBy(*by, "column", "value").agg(F.count(F.lit(1)).alias("n"))
    return range_buckets(counts, *by, "column", "value")


def running_counts(values: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The known values of a :func:`value_table` with ``__from`` and ``__upto``, how many values of the
    column (and group) lie below and up to each, and ``__total``, how many there are."""
    group = [*by, "column"]
    known = values.where(F.col("value").isNotNull())
    sums = known.groupBy(*group, RANGE).agg(F.sum("n").alias("__n"))
    before = Window.partitionBy(*group).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *[F.col(c).alias(f"__on_{c}") for c in group],
        F.col(RANGE).alias("__on_range"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"),
        F.sum("__n").over(Window.partitionBy(*group)).alias("__total"),
    )
    match = F.col(RANGE) == F.col("__on_range")
    for c in group:
        match = match & F.col(c).eqNullSafe(F.col(f"__on_{c}"))
    placed = known.join(offsets, match)
    inside = Window.partitionBy(*group, RANGE).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    return placed.withColumn("__upto", F.col("__o") + F.sum("n").over(inside)).withColumn("__from", F.col("__upto") - F.col("n"))


def quantiles(values: DataFrame, probabilities: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """``(*by, column, count, q0, q1, ...)`` from a :func:`value_table`: exact, between neighbours by
    linear interpolation.  A column without values has NULLs.  A small table, written once."""
    group = [*by, "column"]
    ranked = running_counts(values, by)
    picks = [F.max("__total").alias("count")]
    for i, p in enumerate(probabilities):
        at = F.lit(float(p)) * (F.col("__total") - 1)
        for name, rank in ((f"__lo{i}", F.floor(at)), (f"__hi{i}", F.ceil(at))):
            picks.append(F.max(F.when((F.col("__from") <= rank) & (rank < F.col("__upto")), F.col("value"))).alias(name))
    found = ranked.groupBy(*group).agg(*picks)
    out = []
    for i, p in enumerate(probabilities):
        at = F.lit(float(p)) * (F.col("count") - 1)
        out.append((F.col(f"__lo{i}") + (F.col(f"__hi{i}") - F.col(f"__lo{i}")) * (at - F.floor(at))).alias(f"q{i}"))
    some = values.select(*group).distinct()
    full = some.withColumnsRenamed({c: f"__on_{c}" for c in group})
    match = F.lit(True)
    for c in group:
        match = match & F.col(c).eqNullSafe(F.col(f"__on_{c}"))
    joined = full.join(found.select(*group, "count", *out), match, "left")
    return shared_table(joined.select(*[F.col(f"__on_{c}").alias(c) for c in group], F.coalesce("count", F.lit(0)).alias("count"), *[f"q{i}" for i in range(len(probabilities))]), "quantiles")
