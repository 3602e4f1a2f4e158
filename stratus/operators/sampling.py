"""Ordering, top-k, deterministic samples, train/test splits and folds.

Random order is a seeded 64-bit hash of the row key, so splits are reproducible and
survive task retries.  Exact-size splits need each row's rank in hash order; ranks are
computed with ``series.sequence`` bucketed by the hash's top bits, so no task holds more
than ~n/2^bits rows even when one class holds most rows.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratus.operators import series as S
from stratus.operators.ranges import with_positions

HASH_BUCKET_BITS = 14
#: rows that one task of a forest holds in memory
ROWS_PER_TASK = 500_000


def spread(df: DataFrame, rows: int, rows_per_task: int = ROWS_PER_TASK, order: Sequence[str] = ()) -> DataFrame:
    """``df``, which has about ``rows`` rows, in partitions of equal size: at least as many as the session
    runs tasks side by side, and none above ``rows_per_task`` rows.  (A shuffle's own partitions are merged
    by bytes, into few and large ones for steps that hold much more per row than the shuffle does.)

    Partitions are sorted by ``order``.  Rows of like targets come to the same nodes of a tree, so a forest
    that reads them one after another finds the nodes' statistics in the processor's cache."""
    parts = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / rows_per_task))
    out = df.repartition(parts)
    return out.sortWithinPartitions(*order) if order else out


def sort_by_time(df: DataFrame, ts: str = "datetime", tiebreak: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(F.col(ts).asc_nulls_last(), *[F.col(c).asc_nulls_last() for c in tiebreak])


def head_n(df: DataFrame, n: int = 5, order: Sequence[str | Column] = ()) -> DataFrame:
    """First ``n`` rows in an explicit order (DataFrames carry no row order)."""
    return (df.orderBy(*order) if order else df).limit(n)


def top_k(df: DataFrame, by: str, n: int = 10, descending: bool = True, tiebreak: Sequence[str] = ()) -> DataFrame:
    o = F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_last()
    return df.orderBy(o, *tiebreak).limit(n)


def hash_order(key: Sequence[str], seed: int = 42) -> Column:
    """Seeded pseudo-random order key (bigint) from the row key."""
    return F.xxhash64(F.lit(seed), *[F.col(k) for k in key])


def sample_n(df: DataFrame, n: int, key: Sequence[str], seed: int = 42) -> DataFrame:
    """Uniform sample of ``min(n, rows)`` rows, reproducible for a seed."""
    return df.orderBy(hash_order(key, seed), *key).limit(n)


def _hash_rank(df: DataFrame, key: Sequence[str], group: Sequence[str], seed: int, bits: int) -> DataFrame:
    """``__rank`` of each row in hash order within its group (a NULL group value is a group), and the
    group's ``__total``."""
    h = hash_order(key, seed)
    # arithmetic shift keeps the signed hash order, so the bucket is monotone in it
    tmp = df.withColumns({"__h": h, "__all": F.lit(0)})
    ranked = S.sequence(tmp, [*group, "__all"], ["__h", *key], bucket=F.shiftright(F.col("__h"), 64 - bits), out="__rank", total="__total")
    return ranked.drop("__h", "__all")


def _below(fraction: Column | float) -> Column:
    """The signed 64-bit hash under which a ``fraction`` of all hashes lies, as a double."""
    return F.lit(-(2.0**63)) + F.lit(2.0**64) * (F.lit(fraction) if isinstance(fraction, float) else fraction)


def random_split(
    df: DataFrame, key: Sequence[str], test_fraction: float = 0.2, seed: int = 42, bits: int = HASH_BUCKET_BITS, out: str = "is_test", exact: bool = True
) -> DataFrame:
    """Exactly ``ceil(test_fraction · n)`` rows flagged ``is_test`` (the lowest hashes).

    With ``exact=False`` the rows whose hash lies below a threshold: a projection without exchange that
    flags the same rows on every cluster.  Of n distinct keys a share within ``5 sqrt(f (1 - f) / n)`` of the
    fraction f is flagged (five standard deviations).
    """
    if not exact:
        return df.withColumn(out, hash_order(key, seed).cast("double") < _below(float(test_fraction)))
    ranked = _hash_rank(df, key, (), seed, bits)
    return ranked.withColumn(out, F.col("__rank") <= F.ceil(F.col("__total") * F.lit(test_fraction))).drop("__rank", "__total")


def stratified_split(
    df: DataFrame,
    key: Sequence[str],
    label: str,
    test_fraction: float = 0.2,
    seed: int = 42,
    bits: int = HASH_BUCKET_BITS,
    out: str = "is_test",
    exact: bool = True,
    fractions: Mapping[object, float] | None = None,
) -> DataFrame:
    """``ceil(test_fraction · n_c)`` test rows per class; falls back to :func:`random_split`
    when a class has fewer than two rows (the case a stratified split cannot serve).

    Rows with a NULL label are a class of their own.  The class counts are read while the
    plan is built (one aggregate over the label column).

    With ``exact=False`` every class has a hash threshold of its own: ``fractions`` by label (None for the NULL
    class), ``test_fraction`` for the others.  That is a projection without exchange or count; each
    class's share keeps the bound of :func:`random_split`.
    """
    if not exact:
        fraction = F.lit(float(test_fraction))
        for value, own in (fractions or {}).items():
            fraction = F.when(F.col(label).eqNullSafe(F.lit(value)), F.lit(float(own))).otherwise(fraction)
        return df.withColumn(out, hash_order(key, seed).cast("double") < _below(fraction))
    if fractions:
        raise ValueError("fractions by label need exact=False")
    smallest = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n")).first()[0]
    if smallest is None or smallest < 2:
        return random_split(df, key, test_fraction, seed, bits, out)
    ranked = _hash_rank(df, key, [label], seed, bits)
    return ranked.withColumn(out, F.col("__rank") <= F.ceil(F.col("__total") * F.lit(test_fraction))).drop("__rank", "__total")


def kfold(
    df: DataFrame,
    k: int = 5,
    order: Sequence[str | Column] = (),
    key: Sequence[str] = (),
    label: str | None = None,
    seed: int = 42,
    bits: int = HASH_BUCKET_BITS,
    out: str = "fold",
    bucket: Column | None = None,
) -> DataFrame:
    """Fold ids 0..k-1.

    * ``label`` given: stratified — rows of each class dealt round-robin in hash order.
    * else: contiguous blocks in ``order`` (first ``n % k`` folds one row longer),
      as an unshuffled K-fold does.  The order may be of any type: rows are dealt into sampled ranges
      of equal size when the function is called, and written once.  With ``bucket``, a non-decreasing
      function of the order, rows are ranked in these buckets instead and nothing is written.
    """
    if label is not None:
        ranked = _hash_rank(df, key, [label], seed, bits)
        return ranked.withColumn(out, ((F.col("__rank") - 1) % k).cast("int")).drop("__rank", "__total")
    if bucket is None:
        ranked = with_positions(df, order, "__rank", "__total")
    else:
        ranked = S.sequence(df.withColumn("__all", F.lit(0)), ["__all"], list(order), bucket=bucket, out="__rank", total="__total").drop("__all")
    q = F.floor(F.col("__total") / k)
    r = F.col("__total") - q * k
    g = F.col("__rank") - 1
    fold = F.when(g < r * (q + 1), F.floor(g / (q + 1))).otherwise(r + F.floor((g - r * (q + 1)) / q))
    return ranked.withColumn(out, fold.cast("int")).drop("__rank", "__total")
