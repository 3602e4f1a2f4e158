"""Cleaning, projections and row/column filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratus.functions.numeric import finite_or_null, parse_number
from stratus.functions.roles import TIME_COLUMN_NAMES, TRAINING_EXCLUDED_COLUMNS, dedupe, resolve_time_columns
from stratus.operators.ranges import quantiles, value_table
from stratus.operators.stats import column_stat, numeric_columns


def to_numeric(df: DataFrame, exclude: Sequence[str] | None = None) -> DataFrame:
    """Every column except the time columns -> double (decimal comma, trimmed, junk -> NULL).

    Default exclusions are the known time column names plus the date/hour columns found
    by keyword, so an hour text such as ``'0000 UTC'`` survives for the timestamp.
    """
    if exclude is None:
        exclude = list(TIME_COLUMN_NAMES) + list(resolve_time_columns(df.columns).values())
    skip = set(exclude)
    return df.select(*[parse_number(c).alias(c) if c not in skip else F.col(c) for c in df.columns])


def inf_to_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """±inf and NaN -> NULL on numeric columns."""
    columns = list(columns) if columns is not None else numeric_columns(df)
    return df.withColumns({c: finite_or_null(c) for c in columns}) if columns else df


def drop_outliers_sigma(df: DataFrame, columns: Sequence[str] | None = None, k: float = 10.0, remove_inf: bool = True) -> DataFrame:
    """Per column, values farther than ``k`` sample standard deviations from the mean -> NULL.

    Columns whose std is NULL or 0 are left alone.  Mean and std of all columns come from
    one aggregate (merged scalar subquery); the rows are then rewritten in one projection.
    """
    columns = list(columns) if columns is not None else numeric_columns(df)
    if remove_inf:
        df = inf_to_null(df, columns)
    out = {}
    for c in columns:
        mean = column_stat(df, F.avg(c).cast("double"))
        std = column_stat(df, F.stddev_samp(c).cast("double"))
        far = std.isNotNull() & (std > 0) & (F.abs(F.col(c) - mean) > F.lit(k) * std)
        out[c] = F.when(far, F.lit(None)).otherwise(F.col(c))
    return df.withColumns(out) if out else df


def outliers_iqr(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column: count and % of rows outside ``[Q1 - 1.5 IQR, Q3 + 1.5 IQR]`` and both bounds.

    Quartiles are exact with linear interpolation (pandas ``quantile``).  One pass over the rows:
    quartiles and counts come from the table of distinct values, which is written while the plan
    is built.  Output: ``column, n_outliers, pct_outliers, lower_bound, upper_bound`` (rounded to 2).
    """
    columns = list(columns) if columns is not None else numeric_columns(df)
    values = value_table(df, columns)
    quart = quantiles(values, [0.25, 0.75]).select("column", "q0", "q1")
    iqr = F.col("q1") - F.col("q0")
    lo, hi = F.col("q0") - F.lit(1.5) * iqr, F.col("q1") + F.lit(1.5) * iqr
    out = F.sum(F.when((F.col("value") < lo) | (F.col("value") > hi), F.col("n")).otherwise(0))
    counted = values.join(quart, "column").groupBy("column", lo.alias("lo"), hi.alias("hi")).agg(out.alias("out"), F.sum("n").alias("rows"))
    return counted.select(
        "column",
        F.col("out").cast("long").alias("n_outliers"),
        F.round(F.col("out") * F.lit(100.0) / F.col("rows"), 2).alias("pct_outliers"),
        F.round("lo", 2).alias("lower_bound"),
        F.round("hi", 2).alias("upper_bound"),
    )


def drop_null_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """``dropna()``: drop rows with a NULL in any (or any of ``subset``) column."""
    return df.na.drop(how="any", subset=list(subset) if subset else None)


def drop_null_thresh(df: DataFrame, thresh: int = 3, subset: Sequence[str] | None = None) -> DataFrame:
    """Keep rows holding at least ``thresh`` non-NULL values (NaN counts as missing)."""
    cols = list(subset) if subset else df.columns
    valid = sum((_present(df, c)).cast("int") for c in cols)
    return df.where(valid >= F.lit(thresh))


def _present(df: DataFrame, c: str) -> Column:
    dt = df.schema[c].dataType.typeName()
    if dt in ("double", "float"):
        return F.col(c).isNotNull() & ~F.isnan(c)
    return F.col(c).isNotNull()


def null_count_expr(df: DataFrame, cols: Sequence[str]) -> Column:
    """Number of missing values in a row across ``cols``."""
    return sum((~_present(df, c)).cast("int") for c in cols) if cols else F.lit(0)


def drop_sparse_rows(df: DataFrame, features: Sequence[str], targets: Sequence[str] = (), max_null_fraction: float = 0.5) -> DataFrame:
    """Drop rows whose share of missing features exceeds ``max_null_fraction``; targets must be present."""
    cond = null_count_expr(df, features) <= F.lit(len(features) * max_null_fraction)
    for t in targets:
        cond = cond & _present(df, t)
    return df.where(cond)


def complete_column_shares(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: share of non-NULL values per column (used by ``select_complete_columns``)."""
    columns = list(columns) if columns is not None else numeric_columns(df)
    n = F.count(F.lit(1))
    return df.agg(*[(F.count(c) / n).alias(c) for c in columns])


def select_complete_columns(
    df: DataFrame,
    min_share: float = 0.70,
    time_columns: Sequence[str] = TIME_COLUMN_NAMES,
    target: str | None = "Chuva",
) -> DataFrame:
    """Time columns + numeric columns with ≥ ``min_share`` non-NULL values + target, deduplicated.

    The column choice needs the shares (one aggregate action, one row); the returned
    DataFrame stays lazy.
    """
    numeric = numeric_columns(df)
    shares = complete_column_shares(df, numeric).first() if numeric else None
    keep_numeric = [c for c in numeric if shares is not None and shares[c] is not None and shares[c] >= min_share]
    cols = [c for c in time_columns if c in df.columns] + keep_numeric
    if target and target in df.columns:
        cols.append(target)
    return df.select(*dedupe(cols))


def select_features(df: DataFrame, targets: Sequence[str] = ("Chuva",), excluded: Sequence[str] = TRAINING_EXCLUDED_COLUMNS) -> list[str]:
    """Feature column names: everything except time columns and targets (order kept)."""
    skip = set(excluded) | set(targets)
    return [c for c in df.columns if c not in skip]


def select_numeric(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    return df.select(*numeric_columns(df, tuple(exclude)))


def series_projection(df: DataFrame, column: str, ts: str | None = None) -> DataFrame:
    """(time, value) pairs of one measure, time = ``datetime`` if present else ``Data``."""
    ts = ts or ("datetime" if "datetime" in df.columns else "Data")
    return df.select(F.col(ts).alias("time"), F.col(column).alias("value"))


def feature_expressions(df: DataFrame, features: Sequence[str], medians: dict[str, float] | None = None, sources: dict[str, str] | None = None) -> list[Column]:
    """One double per model feature: missing features = 0, NULLs filled with the training median of
    the feature (else 0).  ``sources`` names the column of a feature where it is not the feature's own."""
    medians, sources = medians or {}, sources or {}
    out = []
    for f in features:
        source = sources.get(f, f)
        filled = F.coalesce(F.col(f"`{source}`").try_cast("double"), F.lit(float(medians.get(f) or 0.0)))
        out.append(filled if source in df.columns else F.lit(0.0))
    return out


def align_features(df: DataFrame, features: Sequence[str], medians: dict[str, float] | None = None) -> DataFrame:
    """Model input in training order (:func:`feature_expressions`); extra columns are dropped."""
    return df.select(*[e.alias(f) for e, f in zip(feature_expressions(df, features, medians), features, strict=True)])


def threshold_decision(df: DataFrame, prob: str = "prob_chuva", threshold: float = 0.5, out: str = "vai_chover") -> DataFrame:
    """``out = prob >= threshold`` plus the distance to the threshold in percentage points."""
    return df.withColumns(
        {
            out: (F.col(prob) >= F.lit(threshold)).cast("int"),
            "delta_pp": (F.col(prob) - F.lit(threshold)) * F.lit(100.0),
        }
    )
