"""Missing-value filling: interpolation, forward/backward fill, mean/median, drop.

All per-station fills follow row order inside a station (``stratus.operators.series``);
statistics fills use one aggregate evaluated as a scalar subquery.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratus.operators import series as S
from stratus.operators.ranges import quantiles, value_table
from stratus.operators.stats import column_stat, numeric_columns


def fill_interpolate(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    key: Sequence[str] = ("station_id",),
    order: Sequence[str | Column] = ("ts",),
    limit: int | None = 3,
    bucket: Column | None = None,
    parts: int | None = None,
) -> DataFrame:
    """Linear interpolation by row position with a fill limit on *both* sides of a gap.

    A missing value is filled when it lies within ``limit`` rows after the previous
    valid value or within ``limit`` rows before the next one (``limit=None``: always).
    Between two valid values the fill is linear in row position; before the first /
    after the last valid value the nearest valid value is copied.

    Everything runs inside the ``(station, day)`` partitioning of the row ranking: one
    summary row per bucket (row count, first/last valid position and value) gives each
    bucket its offset and the nearest valid points before and after it, so the endpoints
    may lie any number of buckets away without a second exchange of the rows.
    """
    columns = list(columns) if columns is not None else [c for c in numeric_columns(df) if c not in key]
    if not columns:
        return df
    original = list(df.columns)
    kcols, ranked = S.bucket_ranks(df, list(key), order, bucket, parts)
    r = F.col(S.RANK)
    cell = {c: F.col(f"{S.ROW}.`{c}`") for c in columns}
    valid_r = {c: F.when(cell[c].isNotNull(), r) for c in columns}
    # per (station, bucket): rows and the first/last valid local rank and value (hash aggregate,
    # computed inside the ranking's partitioning)
    summary = S.bucket_summary(
        ranked,
        kcols,
        *[F.max(valid_r[c]).alias(f"__lr{i}") for i, c in enumerate(columns)],
        *[F.max_by(cell[c], valid_r[c]).alias(f"__lv{i}") for i, c in enumerate(columns)],
        *[F.min(valid_r[c]).alias(f"__fr{i}") for i, c in enumerate(columns)],
        *[F.min_by(cell[c], valid_r[c]).alias(f"__fv{i}") for i, c in enumerate(columns)],
    )
    earlier = Window.partitionBy(*kcols).orderBy(S.BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*kcols).orderBy(F.col(S.BUCKET).desc()).rowsBetween(Window.unboundedPreceding, -1)
    offs = summary.withColumn("__o", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))

    def pt(p, v):
        return F.when(p.isNotNull(), F.struct((F.col("__o") + p).alias("p"), v.alias("v")))

    carry = offs.select(
        *kcols,
        S.BUCKET,
        "__o",
        *[F.last(pt(F.col(f"__lr{i}"), F.col(f"__lv{i}")), ignorenulls=True).over(earlier).alias(f"__pin{i}") for i in range(len(columns))],
        *[F.last(pt(F.col(f"__fr{i}"), F.col(f"__fv{i}")), ignorenulls=True).over(later).alias(f"__nin{i}") for i in range(len(columns))],
    )
    rows = ranked.where(S.whole_row(ranked)).join(carry, on=[*kcols, S.BUCKET], how="inner")
    rows = rows.select("*", *S.unpacked(ranked), (F.col("__o") + r).alias(S.SEQ)).drop(S.ROW)
    seq = F.col(S.SEQ)

    def point(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.struct(seq.alias("p"), F.col(c).alias("v")))

    upto = Window.partitionBy(*kcols, S.BUCKET).orderBy(S.RANK).rowsBetween(Window.unboundedPreceding, 0)
    # look-forward over a descending order keeps the frame running (linear, not quadratic)
    from_here = Window.partitionBy(*kcols, S.BUCKET).orderBy(r.desc()).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumns(
        {
            **{f"__pl{i}": F.last(point(c), ignorenulls=True).over(upto) for i, c in enumerate(columns)},
            **{f"__nl{i}": F.last(point(c), ignorenulls=True).over(from_here) for i, c in enumerate(columns)},
        }
    )
    lim = F.lit(limit) if limit is not None else None
    filled = {}
    for i, c in enumerate(columns):
        prev = F.coalesce(F.col(f"__pl{i}"), F.col(f"__pin{i}"))
        nxt = F.coalesce(F.col(f"__nl{i}"), F.col(f"__nin{i}"))
        dp = seq - prev["p"]
        dn = nxt["p"] - seq
        near_prev = prev.isNotNull() if lim is None else prev.isNotNull() & (dp <= lim)
        near_next = nxt.isNotNull() if lim is None else nxt.isNotNull() & (dn <= lim)
        linear = prev["v"] + (nxt["v"] - prev["v"]) * dp.cast("double") / (nxt["p"] - prev["p"]).cast("double")
        value = (
            F.when(F.col(c).isNotNull(), F.col(c))
            .when(prev.isNotNull() & nxt.isNotNull() & (near_prev | near_next), linear)
            .when(prev.isNotNull() & nxt.isNull() & near_prev, prev["v"])
            .when(prev.isNull() & nxt.isNotNull() & near_next, nxt["v"])
        )
        filled[c] = value.cast(df.schema[c].dataType)
    return local.withColumns(filled).select(*original)


def fill_forward(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    key: Sequence[str] = ("station_id",),
    order: Sequence[str | Column] = ("ts",),
    limit: int = 3,
    bucket: Column | None = None,
) -> DataFrame:
    """Carry the last valid value forward over at most ``limit`` rows (one large exchange:
    see ``series.bucket_windows``)."""
    columns = list(columns) if columns is not None else [c for c in numeric_columns(df) if c not in key]
    original = list(df.columns)
    fns = {f"__ff_{c}": (lambda w, c=c: F.last(c, ignorenulls=True).over(w.rowsBetween(-limit, 0))) for c in columns}
    out = S.bucket_windows(df, list(key), order, fns, columns, before=max(limit, 1), bucket=bucket)
    return out.select(*[F.col(f"__ff_{c}").alias(c) if c in columns else F.col(c) for c in original])


def fill_backward(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    key: Sequence[str] = ("station_id",),
    order: Sequence[str | Column] = ("ts",),
    limit: int = 3,
    bucket: Column | None = None,
) -> DataFrame:
    """Carry the next valid value backward over at most ``limit`` rows (one large exchange:
    see ``series.bucket_windows``)."""
    columns = list(columns) if columns is not None else [c for c in numeric_columns(df) if c not in key]
    original = list(df.columns)
    fns = {f"__bf_{c}": (lambda w, c=c: F.first(c, ignorenulls=True).over(w.rowsBetween(0, limit))) for c in columns}
    out = S.bucket_windows(df, list(key), order, fns, columns, after=max(limit, 1), bucket=bucket)
    return out.select(*[F.col(f"__bf_{c}").alias(c) if c in columns else F.col(c) for c in original])


def fill_mean(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Fill with the column mean (one aggregate, inlined as a scalar subquery)."""
    columns = list(columns) if columns is not None else numeric_columns(df)
    return df.withColumns({c: F.coalesce(F.col(c), column_stat(df, F.avg(c))) for c in columns})


def medians(df: DataFrame, columns: Sequence[str], exact: bool = True) -> dict[str, float | None]:
    """Median of each column (one small row per column is read); exact, or ``percentile_approx``."""
    if exact:
        return {r["column"]: r["q0"] for r in quantiles(value_table(df, columns), [0.5]).collect()} if columns else {}
    row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), 0.5, 10_000).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    return dict(zip(columns, row, strict=True))


def fill_median(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """Fill with the column median (exact by default; ``exact=False`` -> percentile_approx).

    The medians are read while the plan is built.
    """
    columns = list(columns) if columns is not None else numeric_columns(df)
    found = medians(df, columns, exact)
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(found.get(c)).cast("double")) for c in columns})


def fill_median_or_zero(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """Training fill: median, or 0 when a column has no value at all."""
    columns = list(columns) if columns is not None else numeric_columns(df)
    found = medians(df, columns, exact)
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(found.get(c)).cast("double"), F.lit(0.0)) for c in columns})


def fill_drop(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Method ``'drop'``: remove rows with a missing value in any of ``columns``."""
    columns = list(columns) if columns is not None else numeric_columns(df)
    return df.na.drop(how="any", subset=columns) if columns else df


def fill_nulls(df: DataFrame, method: str = "interpolate", columns: Sequence[str] | None = None, limit: int = 3, **kw) -> DataFrame:
    """Dispatcher with the reference's method names."""
    if method == "interpolate":
        return fill_interpolate(df, columns, limit=limit, **kw)
    if method == "ffill":
        return fill_forward(df, columns, limit=limit, **kw)
    if method == "bfill":
        return fill_backward(df, columns, limit=limit, **kw)
    if method == "mean":
        return fill_mean(df, columns)
    if method == "median":
        return fill_median(df, columns)
    if method == "drop":
        return fill_drop(df, columns)
    raise ValueError(f"unknown fill method {method!r}")
