"""Ordered per-station series without putting a whole station into one task.

The reference shifts and rolls by *row position* inside a station's time order.  The
plain Spark form, ``Window.partitionBy(station).orderBy(ts)``, sends every row of a
station to one task; with one station holding a third of all rows that task would sort
a third of the data.  Instead rows are ranked inside ``(station, time bucket)`` groups,
and one summary row per bucket (:func:`bucket_summary`) carries what crosses buckets:

* :func:`sequence` adds each bucket's offset, a running sum over the bucket table;
* :func:`bucket_windows` (lags, rolling stats, forward and backward fill) carries the last
  and first few values of each bucket as bounded arrays to the buckets that look at them;
* interpolation carries the nearest valid points (see ``stratus.operators.fill``).

The rows are shuffled once.  Task size is the rows of one bucket: the bucket width is a
parameter (``bucket=``, default ``DEFAULT_BUCKET_SECONDS``), to be far above the longest
look-back in rows and low enough for one bucket of the busiest station to fit a task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec

#: ten days: 240 rows of an hourly station
DEFAULT_BUCKET_SECONDS = 864_000
#: rows that a bucket of the busiest station may hold, and rows of one task; see dense_bucket
BUCKET_ROWS, TASK_ROWS = 20_000, 150_000
SEQ = "__seq"
HALO = "__halo"
RANK = "__r"
BUCKET = "__bucket"
#: rows without an order value come last, spread by a hash over this many buckets
NULL_BUCKETS = 1024
_FIRST_NULL_BUCKET = 2**62
ROW = "__row"


def time_bucket(ts: str | Column, seconds: int = DEFAULT_BUCKET_SECONDS) -> Column:
    """Monotone coarse bucket of a wall-clock timestamp (no time-zone gaps involved)."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    wall = (
        F.unix_date(F.to_date(ts)).cast("long") * 86_400
        + F.hour(ts).cast("long") * 3_600
        + F.minute(ts).cast("long") * 60
        + F.second(ts).cast("long")
    )
    return F.floor(wall / F.lit(seconds)).cast("long")


def dense_bucket(df: DataFrame, key: Sequence[str], ts: str, rows: int = BUCKET_ROWS) -> tuple[Column, int | None]:
    """:func:`time_bucket` of a width that suits ``df``: ten days, or less where a station has more than ``rows``
    rows in ten days (down to a second).  Counts the rows by station and bucket when called; again for each
    narrower width, until the fullest bucket fits.

    Also returns the number of partitions that these buckets should be shuffled into (``parts=``): one for
    ``TASK_ROWS`` rows, None for tables below that.
    """
    seconds, known = DEFAULT_BUCKET_SECONDS, df.select(*key, ts)
    while True:
        counts = known.groupBy(*key, time_bucket(ts, seconds).alias(BUCKET)).agg(F.count(F.lit(1)).alias("n"))
        fullest, total = counts.agg(F.max(F.when(F.col(BUCKET).isNotNull(), F.col("n"))), F.sum("n")).first()
        if seconds == 1 or (fullest or 0) <= rows:
            break
        # a margin, as buckets of one width are not equally full
        seconds = max(1, min(seconds // 2, int(seconds * 0.75 * rows / fullest)))
    parts = None
    if (total or 0) > TASK_ROWS:
        parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_ROWS))
    return time_bucket(ts, seconds), parts


def _default_for(dt: T.DataType) -> Column:
    if isinstance(dt, T.StringType):
        return F.lit("")
    if isinstance(dt, T.BooleanType):
        return F.lit(False)
    if isinstance(dt, (T.DateType,)):
        return F.lit("1970-01-01").cast("date")
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return F.lit("1970-01-01 00:00:00").cast(dt)
    if isinstance(dt, T.NumericType):
        return F.lit(0).cast(dt)
    return F.lit(None).cast(dt)


def key_columns(df: DataFrame, key: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Null-safe helper copies of the station key for plain-equality joins and partitioning.

    A NULL station is its own group (as in ``groupBy``); plain ``=`` joins keep the
    hash partitioning of the ranked rows, ``<=>`` joins would force another shuffle.
    """
    names: list[str] = []
    cols: dict[str, Column] = {}
    for i, c in enumerate(key):
        k, kn = f"__k{i}", f"__k{i}n"
        if k in df.columns:
            names += [k, kn]
            continue
        cols[k] = F.coalesce(F.col(c), _default_for(df.schema[c].dataType))
        cols[kn] = F.col(c).isNull()
        names += [k, kn]
    return (df.withColumns(cols) if cols else df), names


def _order_cols(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(o).asc_nulls_last() if isinstance(o, str) else o for o in order]


def default_bucket(df: DataFrame, order: Sequence[str | Column]) -> Column:
    first = order[0]
    if not (isinstance(first, str) and isinstance(df.schema[first].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))):
        raise ValueError("pass `bucket` (a coarse, non-decreasing function of the order) for non-time orders")
    return time_bucket(first)


def bucket_ranks(df: DataFrame, key: Sequence[str], order: Sequence[str | Column], bucket: Column | None = None, parts: int | None = None):
    """Rows ranked 1..m inside ``(key, bucket)``: the key helpers, ``BUCKET``, ``RANK`` and the row as one struct ``ROW``.

    ``bucket`` must not decrease along ``order``.  Rows whose bucket is NULL follow all
    others, in an order of their own: by a hash of the order columns, then by these.

    The ranked rows are read twice, by the bucket summary and as rows.  Both read the whole struct
    (see :func:`whole_row`), so that Spark plans one scan and one shuffle for them; with columns of
    their own they would be pruned to different plans.  Returns ``(helper names, ranked rows)``.

    With ``parts`` the buckets are shuffled into that many partitions, which Spark does not merge.
    """
    original = list(df.columns)
    df, kcols = key_columns(df, key)
    bucket = default_bucket(df, order) if bucket is None else bucket
    plain = [F.col(o) if isinstance(o, str) else o for o in order]
    spread = F.lit(_FIRST_NULL_BUCKET) + F.pmod(F.xxhash64(*plain), F.lit(NULL_BUCKETS))
    # never NULL, and Spark can tell: otherwise a join would filter one of the two readers only
    placed = df.withColumn(BUCKET, F.coalesce(bucket.cast("long"), spread.cast("long"), F.lit(_FIRST_NULL_BUCKET)))
    if parts:
        placed = placed.repartition(parts, *kcols, BUCKET)
    by = Window.partitionBy(*kcols, BUCKET).orderBy(*_order_cols(order))
    packed = placed.withColumn(ROW, F.struct(*[F.col(f"`{c}`") for c in original]))
    return kcols, packed.withColumn(RANK, F.row_number().over(by)).select(*kcols, BUCKET, RANK, ROW)


def _hashable(dt: T.DataType) -> bool:
    return not isinstance(dt, (T.MapType, T.VariantType))


def whole_row(ranked: DataFrame) -> Column:
    """True for every row; reads the whole struct.  (A type without a hash is left out.)"""
    fields = ranked.schema[ROW].dataType.fields
    whole = F.col(ROW) if all(_hashable(f.dataType) for f in fields) else F.col(f"{ROW}.`{fields[0].name}`")
    return F.pmod(F.xxhash64(whole), F.lit(2)) < 2


def unpacked(ranked: DataFrame) -> list[Column]:
    """The columns of the rows."""
    return [F.col(f"{ROW}.`{c}`").alias(c) for c in ranked.schema[ROW].dataType.names]


def bucket_summary(ranked: DataFrame, kcols: Sequence[str], *aggs: Column) -> DataFrame:
    """One row per ``(key, bucket)``: row count ``__n`` and ``aggs``, inside the ranking's partitions."""
    return ranked.where(whole_row(ranked)).groupBy(*kcols, BUCKET).agg(F.max(RANK).cast("long").alias("__n"), *aggs)


def bucket_offsets(summary: DataFrame, kcols: Sequence[str]) -> DataFrame:
    """Adds ``__o``, the rows of the key before each bucket, and ``__total``, all its rows."""
    before = Window.partitionBy(*kcols).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    return summary.withColumns({"__o": F.coalesce(F.sum("__n").over(before), F.lit(0)), "__total": F.sum("__n").over(Window.partitionBy(*kcols))})


def sequence(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str | Column],
    bucket: Column | None = None,
    out: str = SEQ,
    total: str | None = None,
) -> DataFrame:
    """Add ``out``: 1-based position of each row inside its ``key`` in ``order`` (and ``total``: the
    key's number of rows).

    ``bucket`` must not decrease along ``order`` (default: ten days of the first order column).
    Task size is bounded by the rows of one ``(key, bucket)``.
    """
    if out in df.columns:
        return df
    kcols, ranked = bucket_ranks(df, key, order, bucket)
    offsets = bucket_offsets(bucket_summary(ranked, kcols), kcols).drop("__n")
    rows = ranked.where(whole_row(ranked)).join(offsets, on=[*kcols, BUCKET], how="inner")
    extra = [F.col("__total").cast("long").alias(total)] if total else []
    return rows.select(*unpacked(ranked), (F.col("__o") + F.col(RANK)).cast("long").alias(out), *extra)


def _placed(array: str) -> Column:
    """The rows of an array with their position in the key."""
    return F.transform(array, lambda t: t.withField("r", t["r"] + F.col("__o")))


def _joined(*arrays: Column) -> Column:
    return F.flatten(F.array_compact(F.array(*arrays)))


def rows_before(offsets: DataFrame, kcols: Sequence[str], tail: str, n: int) -> tuple[DataFrame, Column]:
    """The last ``n`` rows before each bucket (and up to ``n`` more), from each bucket's last rows ``tail``.

    Buckets that begin inside the look-back are wanted whole, and of the others only the nearest one: a
    bucket meets 2 ``n`` rows at most, however many buckets hold them.
    """
    placed = offsets.withColumns({"__bucket_start": F.col("__o"), "__tails": _placed(tail)})
    by = Window.partitionBy(*kcols).orderBy("__bucket_start")
    inside = F.collect_list("__tails").over(by.rangeBetween(-n, -1))
    reaching = F.last("__tails").over(by.rangeBetween(Window.unboundedPreceding, -n - 1))
    return placed, _joined(reaching, F.flatten(inside))


def rows_after(offsets: DataFrame, kcols: Sequence[str], head: str, n: int) -> tuple[DataFrame, Column]:
    """The first ``n`` rows after each bucket (and up to ``n`` more): :func:`rows_before` looking ahead."""
    placed = offsets.withColumns({"__bucket_end": F.col("__o") + F.col("__n"), "__heads": _placed(head)})
    by = Window.partitionBy(*kcols)
    inside = F.collect_list("__heads").over(by.orderBy("__bucket_end").rangeBetween(1, n))
    # descending, so that the running frame grows by a row at a time
    reaching = F.last("__heads").over(by.orderBy(F.desc("__bucket_end")).rangeBetween(Window.unboundedPreceding, -n - 1))
    return placed, _joined(F.flatten(inside), reaching)


def bucket_windows(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str | Column],
    columns: dict[str, Callable[[WindowSpec], Column]],
    values: Sequence[str],
    before: int = 0,
    after: int = 0,
    bucket: Column | None = None,
    parts: int | None = None,
) -> DataFrame:
    """Add window columns ``name -> fn(window)`` computed per key in row order.

    Frames reach at most ``before`` rows back and ``after`` ahead, and look at ``values`` only.
    The rows are shuffled once.  Each bucket's last ``before`` and first ``after`` rows (``values``
    only) travel as arrays over the bucket table to the buckets next to it (as many as hold that
    many rows), where they stand before and after the bucket's own rows.  What a bucket carries is
    linear in ``before`` and ``after``, also for frames of hundreds of rows.
    """
    kcols, ranked = bucket_ranks(df, key, order, bucket, parts)
    nparts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rank = F.col(RANK)
    held = F.struct(rank.cast("long").alias("r"), *[F.col(f"{ROW}.`{c}`").alias(c) for c in values])
    size = F.count(F.lit(1)).over(Window.partitionBy(*kcols, BUCKET))
    sized = ranked.withColumn("__size", size) if before else ranked
    ends = [F.sort_array(F.collect_list(F.when(rank > F.col("__size") - before, held))).alias("__tail")] if before else []
    ends += [F.sort_array(F.collect_list(F.when(rank <= after, held))).alias("__head")] if after else []
    offsets = bucket_offsets(bucket_summary(sized, kcols, *ends), kcols)
    near = []
    if before:
        offsets, earlier = rows_before(offsets, kcols, "__tail", before)
        near.append(F.slice(earlier, F.greatest(F.size(earlier) - before + 1, F.lit(1)), F.lit(before)))
    if after:
        offsets, later = rows_after(offsets, kcols, "__head", after)
        near.append(F.slice(later, F.lit(1), F.lit(after)))
    names = [f"__near{i}" for i in range(len(near))]
    carried = offsets.withColumns(dict(zip(names, near)))
    carried = carried.withColumn("__near", F.concat(*names)).where(F.size("__near") > 0)
    # one row per bucket is shuffled, to where the bucket's rows are, and unfolded there
    halo = carried.select(*kcols, BUCKET, "__o", "__near").repartition(nparts, *kcols, BUCKET).select(*kcols, BUCKET, "__o", F.explode("__near").alias("__t"))
    halo = halo.select(*kcols, BUCKET, (F.col("__t.r") - F.col("__o")).alias(RANK), F.lit(True).alias(HALO), *[F.col(f"__t.`{c}`").alias(c) for c in values])
    rows = ranked.where(whole_row(ranked)).select(*kcols, BUCKET, rank.cast("long").alias(RANK), F.lit(False).alias(HALO), *unpacked(ranked))
    both = rows.unionByName(halo, allowMissingColumns=True)
    w = Window.partitionBy(*kcols, BUCKET).orderBy(RANK)
    out = both.withColumns({name: fn(w) for name, fn in columns.items()})
    return out.where(~F.col(HALO)).select(*df.columns, *columns)
