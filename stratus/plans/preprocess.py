"""Preprocessing composites: raw station rows -> model-ready observation table."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratus.functions.calendar import build_timestamp
from stratus.functions.roles import (
    LAG_KEYWORDS,
    RAIN_KEYWORDS,
    ROLLING_KEYWORDS,
    TIME_COLUMN_NAMES,
    columns_with_keywords,
    resolve_measure_columns,
    resolve_time_columns,
)
from stratus.operators import clean, features, fill, series
from stratus.operators.stats import numeric_columns
from stratus.sources.files import sink_csv
from stratus.sources.station_csv import STATION_PATTERN, scan_station_csv

TS = "datetime"
STATION = "station"


def lag_candidates(columns: Sequence[str]) -> list[str]:
    """Columns that lags may be made of, in column order."""
    return columns_with_keywords(columns, LAG_KEYWORDS)


def rolling_candidates(columns: Sequence[str]) -> list[str]:
    """Columns that rolling stats may be made of, in column order."""
    return columns_with_keywords(columns, ROLLING_KEYWORDS)


def fit_transform(
    df: DataFrame,
    create_target: bool = True,
    rain_column: str | None = None,
    create_lags: bool = False,
    create_rolling: bool = False,
    key: Sequence[str] | None = None,
    sigma: float = 10.0,
    sigma_exclude: Sequence[str] = (),
    interpolate_limit: int | None = 3,
    lag_columns: Sequence[str] | None = None,
    rolling_columns: Sequence[str] | None = None,
    tie_break: Sequence[str] | None = None,
) -> DataFrame:
    """Raw station rows -> cleaned, filled, labelled and feature-enriched rows.

    Steps: numeric coercion (time texts kept) -> 10σ outliers -> timestamp -> per-station
    interpolation in time order -> rain label -> calendar and weather features ->
    optional lags / rolling stats -> rows with missing generated values dropped.
    ``key`` names the station column(s); default ``station``, else ``source_file``, when present.
    ``lag_columns`` default to the first three temperature / humidity / pressure measures and
    ``rolling_columns`` to the first two (reference choice; :func:`lag_candidates` and
    :func:`rolling_candidates` list them all).  Rows of one station and time are in the order of
    ``tie_break`` (default: a hash of the whole row).  The stations' rows are counted when this is called,
    for time buckets that fit the densest of them.
    """
    if key is None:
        key = next(([c] for c in (STATION, "source_file") if c in df.columns), [])
    key = list(key)
    times = resolve_time_columns(df.columns)
    keep_text = list(TIME_COLUMN_NAMES) + list(times.values()) + key
    out = clean.to_numeric(df, exclude=keep_text)
    measures = [c for c in numeric_columns(out) if c not in key]
    out = clean.drop_outliers_sigma(out, [c for c in measures if c not in set(sigma_exclude)], k=sigma)
    if "data" in times:
        hour = F.col(times["hora"]) if "hora" in times else None
        out = out.withColumn(TS, build_timestamp(F.col(times["data"]).cast("string"), hour))
    skey = key or ["__series"]
    if not key:
        out = out.withColumn("__series", F.lit(0))
    ties = list(tie_break) if tie_break is not None else [F.xxhash64(*[F.col(c) for c in df.columns])]
    order = [TS, *ties] if TS in out.columns else None
    if order is None:
        raise ValueError("no date column found; cannot order the series")
    bucket, parts = series.dense_bucket(out, skey, TS)
    out = fill.fill_interpolate(out, measures, key=skey, order=order, limit=interpolate_limit, bucket=bucket, parts=parts)
    if create_target:
        rain = rain_column or next(iter(columns_with_keywords(out.columns, RAIN_KEYWORDS)), None)
        if rain is not None:
            out = features.rain_label(out, rain)
    out = features.calendar_features(out, TS)
    out = features.weather_features(out, resolve_measure_columns(out.columns))
    generated: list[str] = []
    if create_lags or create_rolling:
        lag_cols = list(lag_columns if lag_columns is not None else lag_candidates(measures)[:3]) if create_lags else []
        roll_cols = list(rolling_columns if rolling_columns is not None else rolling_candidates(measures)[:2]) if create_rolling else []
        before = set(out.columns)
        out = features.lag_and_rolling(out, lag_cols, [1, 3, 6], roll_cols, [3, 6, 12], key=skey, order=order, bucket=bucket, parts=parts)
        generated = [c for c in out.columns if c not in before]
        out = out.na.drop(how="any", subset=generated) if generated else out
    if not key:
        out = out.drop("__series")
    return out.drop(*[c for c in out.columns if c.startswith("__k")])


def preprocess_file(
    spark: SparkSession,
    path: str | Sequence[str],
    save_path: str | None = None,
    create_lags: bool = False,
    create_rolling: bool = False,
    station_pattern: str = STATION_PATTERN,
    recursive: bool = False,
    **options,
) -> DataFrame:
    """Read station file(s), run :func:`fit_transform`, optionally write CSV.

    Files of one station (``station_pattern`` in the file name) make one series.
    """
    raw = scan_station_csv(spark, path, station_column=STATION, station_pattern=station_pattern, recursive=recursive)
    out = fit_transform(raw, create_lags=create_lags, create_rolling=create_rolling, **options)
    if save_path:
        sink_csv(out, save_path)
    return out


def _summary_aggs(df: DataFrame, label: str) -> list[Column]:
    aggs = [F.count(F.lit(1)).cast("long").alias("n_rows"), F.lit(len(df.columns)).cast("long").alias("n_columns")]
    if label in df.columns:
        aggs.append((F.avg(F.col(label).cast("double")) * F.lit(100.0)).alias("rain_rate"))
    return aggs


def feature_summary(df: DataFrame, label: str = "Chuva") -> DataFrame:
    """Rows, columns and event rate of a processed table."""
    return df.agg(*_summary_aggs(df, label))


def _feature_group(column: str) -> str:
    if column in features.TEMPORAL_NAMES:
        return "temporal"
    if column in features.WEATHER_NAMES:
        return "weather"
    made = re.search(r"_(lag|rolling)_(?:mean_|std_)?\d+h$", column)
    return made.group(1) if made else "measure"


def feature_report(df: DataFrame, label: str = "Chuva") -> DataFrame:
    """The feature report: ``(section, position, item, value)``.

    Section ``summary`` has the figures of :func:`feature_summary`; each other section lists the names of
    one group of features (``measure``, ``temporal``, ``weather``, ``lag``, ``rolling``) in alphabetical order,
    with the % of rows that have a value (NULL for a table without rows).  One pass over ``df``.
    """
    groups: dict[str, list[str]] = {}
    for c in sorted(c for c in df.columns if c != label):
        groups.setdefault(_feature_group(c), []).append(c)
    listed = [(g, i, c) for g, names in groups.items() for i, c in enumerate(names, 1)]
    rows = F.count(F.lit(1))
    shares = [(F.count(F.col(f"`{c}`")) * F.lit(100.0) / F.nullif(rows, F.lit(0))).alias(f"__share{i}") for i, (_, _, c) in enumerate(listed)]
    summary = ["n_rows", "n_columns"] + (["rain_rate"] if label in df.columns else [])
    wide = df.agg(*_summary_aggs(df, label), *shares)
    items = [("summary", i, c, F.col(c)) for i, c in enumerate(summary, 1)]
    items += [(g, i, c, F.col(f"__share{j}")) for j, (g, i, c) in enumerate(listed)]
    cells = [F.struct(F.lit(g).alias("section"), F.lit(i).alias("position"), F.lit(c).alias("item"), v.cast("double").alias("value")) for g, i, c, v in items]
    return wide.select(F.inline(F.array(*cells)))
