"""Feature columns: calendar parts, cyclic terms, labels, weather spreads, lags, rolling stats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratus.functions import calendar as C
from stratus.functions.numeric import rain_flag
from stratus.functions.weather import discomfort_index, radiation_scaled
from stratus.operators import series as S

# Output names of the derived columns (the reference's feature names, kept for model parity).
TIME_PART_NAMES = ["ano", "mes", "dia", "hora", "dia_semana", "dia_ano", "semana_ano"]
CYCLIC_NAMES = ["hora_sin", "hora_cos", "mes_sin", "mes_cos"]
TEMPORAL_NAMES = [*TIME_PART_NAMES, *CYCLIC_NAMES, "estacao", "periodo_dia", "fim_semana"]


def time_parts(df: DataFrame, ts: str = "datetime", names: Sequence[str] = TIME_PART_NAMES) -> DataFrame:
    """year, month, day, hour, weekday (Monday = 0), day of year, ISO week."""
    t = F.col(ts)
    exprs = [F.year(t), F.month(t), F.dayofmonth(t), F.hour(t), F.weekday(t), F.dayofyear(t), F.weekofyear(t)]
    return df.withColumns(dict(zip(names, exprs)))


def cyclic_encoding(df: DataFrame, hour: str = "hora", month: str = "mes", names: Sequence[str] = CYCLIC_NAMES) -> DataFrame:
    hs, hc = C.cyclic(F.col(hour), 24)
    ms, mc = C.cyclic(F.col(month), 12)
    return df.withColumns(dict(zip(names, [hs, hc, ms, mc])))


def calendar_features(df: DataFrame, ts: str = "datetime") -> DataFrame:
    """All twelve calendar features of the processed table, in one projection."""
    out = cyclic_encoding(time_parts(df, ts))
    return out.withColumns(
        {
            "estacao": C.season(F.col("mes")),
            "periodo_dia": C.day_period(F.col("hora")),
            "fim_semana": C.weekend_flag(F.col("dia_semana")),
        }
    )


def rain_label(df: DataFrame, rain: str = "rain_mm", out: str = "Chuva", threshold: float = 0.0, null_policy: str = "dry") -> DataFrame:
    """``out = 1`` when rain > threshold.  ``null_policy='dry'`` (reference) maps a missing
    amount to 0; ``'drop'`` removes such rows instead."""
    if null_policy == "drop":
        df = df.where(F.col(rain).isNotNull())
    return df.withColumn(out, rain_flag(rain, threshold))


# role -> output feature name and the roles it needs
WEATHER_FEATURES = {
    "amplitude_termica": ("temp_max", "temp_min"),
    "spread_temp_orvalho": ("temp", "dew_point"),
    "variacao_pressao": ("pressure_max", "pressure_min"),
    "variacao_umidade": ("humidity_max", "humidity_min"),
}
WEATHER_NAMES = [*WEATHER_FEATURES, "indice_desconforto", "radiacao_norm"]


def weather_features(df: DataFrame, roles: dict[str, str] | None = None) -> DataFrame:
    """Spreads, discomfort index and scaled radiation for the roles present.

    ``roles`` maps a role (``temp``, ``temp_max`` ...) to a column; default: the role names.
    """
    roles = roles if roles is not None else {c: c for c in df.columns}
    cols: dict[str, Column] = {}
    for name, (a, b) in WEATHER_FEATURES.items():
        if a in roles and b in roles:
            cols[name] = F.col(roles[a]) - F.col(roles[b])
    if "temp" in roles and "humidity" in roles:
        cols["indice_desconforto"] = discomfort_index(F.col(roles["temp"]), F.col(roles["humidity"]))
    if "radiation" in roles:
        cols["radiacao_norm"] = radiation_scaled(F.col(roles["radiation"]))
    return df.withColumns(cols) if cols else df


def lag_features(
    df: DataFrame,
    columns: Sequence[str],
    lags: Sequence[int] = (1, 2, 3, 6, 12, 24),
    key: Sequence[str] = ("station_id",),
    order: Sequence[str | Column] = ("ts",),
    bucket: Column | None = None,
) -> DataFrame:
    """``{col}_lag_{n}h`` = value ``n`` rows earlier in the station's time order."""
    fns = {f"{c}_lag_{n}h": (lambda w, c=c, n=n: F.lag(c, n).over(w)) for c in columns for n in lags}
    return S.bucket_windows(df, list(key), order, fns, columns, before=max(lags), bucket=bucket)


def rolling_features(
    df: DataFrame,
    columns: Sequence[str],
    windows: Sequence[int] = (3, 6, 12, 24),
    key: Sequence[str] = ("station_id",),
    order: Sequence[str | Column] = ("ts",),
    stats: Sequence[str] = ("mean", "std"),
    bucket: Column | None = None,
) -> DataFrame:
    """Trailing ``n``-row mean (≥ 1 value) and sample std (≥ 2 values) per station."""
    fns = {}
    for c in columns:
        for n in windows:
            if "mean" in stats:
                fns[f"{c}_rolling_mean_{n}h"] = lambda w, c=c, n=n: F.avg(c).over(w.rowsBetween(-(n - 1), 0))
            if "std" in stats:
                fns[f"{c}_rolling_std_{n}h"] = lambda w, c=c, n=n: F.stddev_samp(c).over(w.rowsBetween(-(n - 1), 0))
    return S.bucket_windows(df, list(key), order, fns, columns, before=max(max(windows) - 1, 1), bucket=bucket)


def lag_and_rolling(
    df: DataFrame,
    lag_columns: Sequence[str],
    lags: Sequence[int],
    rolling_columns: Sequence[str],
    windows: Sequence[int],
    key: Sequence[str] = ("station_id",),
    order: Sequence[str | Column] = ("ts",),
    bucket: Column | None = None,
    parts: int | None = None,
) -> DataFrame:
    """Lags and rolling stats in one pass (one set of windows)."""
    fns = {f"{c}_lag_{n}h": (lambda w, c=c, n=n: F.lag(c, n).over(w)) for c in lag_columns for n in lags}
    for c in rolling_columns:
        for n in windows:
            fns[f"{c}_rolling_mean_{n}h"] = lambda w, c=c, n=n: F.avg(c).over(w.rowsBetween(-(n - 1), 0))
            fns[f"{c}_rolling_std_{n}h"] = lambda w, c=c, n=n: F.stddev_samp(c).over(w.rowsBetween(-(n - 1), 0))
    before = max([*lags, *[n - 1 for n in windows], 0]) if (lag_columns or rolling_columns) else 0
    if not fns:
        return df
    return S.bucket_windows(df, list(key), order, fns, list(dict.fromkeys([*lag_columns, *rolling_columns])), before=max(before, 1), bucket=bucket, parts=parts)


def scenario_features(
    df: DataFrame,
    year: int,
    temp: str = "temperatura",
    humidity: str = "umidade",
    pressure: str = "pressao",
    radiation: str = "radiacao",
    hour: str = "hora",
    month: str = "mes",
    weekday: str = "dia_semana",
    wind: str | None = "vento",
) -> DataFrame:
    """Manual scenario rows -> the model's feature columns (any number of rows).

    Day of month is fixed to 15, day of year comes from a non-leap table, the week is a
    7-day bucket (not ISO), and ``year`` is passed in (the reference uses the clock).
    Long station header names are produced so models trained on station files align.
    """
    h, m, wd = F.col(hour), F.col(month), F.col(weekday)
    doy = C.day_of_year_fixed(m)
    hs, hc = C.cyclic(h, 24)
    ms, mc = C.cyclic(m, 12)
    t, rh, rad = F.col(temp).cast("double"), F.col(humidity).cast("double"), F.col(radiation).cast("double")
    cols = {
        SCENARIO_HEADERS["temp"]: t,
        SCENARIO_HEADERS["humidity"]: rh,
        SCENARIO_HEADERS["pressure"]: F.col(pressure).cast("double"),
        SCENARIO_HEADERS["radiation"]: rad,
        "indice_desconforto": discomfort_index(t, rh),
        "radiacao_norm": radiation_scaled(rad),
        "hora": h.cast("double"),
        "mes": m.cast("double"),
        "dia_semana": wd.cast("double"),
        "hora_sin": hs,
        "hora_cos": hc,
        "mes_sin": ms,
        "mes_cos": mc,
        "estacao": C.season(m),
        "periodo_dia": C.day_period(h),
        "fim_semana": F.when(wd >= 5, F.lit(1.0)).otherwise(F.lit(0.0)),
        "dia": F.lit(float(C.SCENARIO_DAY_OF_MONTH)),
        "dia_ano": doy.cast("double"),
        "semana_ano": C.week_of_year_fixed(doy).cast("double"),
        "ano": F.lit(float(year)),
    }
    if wind is not None and wind in df.columns:
        cols["VENTO VELOCIDADE"] = F.col(wind).cast("double")
        cols["vento_velocidade"] = F.col(wind).cast("double")
    return df.withColumns(cols)


# Station header names a scenario row is written under (reference feature names).
SCENARIO_HEADERS = {
    "temp": "TEMPERATURA DO AR - BULBO SECO, HORARIA (°C)",
    "humidity": "UMIDADE RELATIVA DO AR, HORARIA (%)",
    "pressure": "PRESSAO ATMOSFERICA AO NIVEL DA ESTACAO, HORARIA (mB)",
    "radiation": "RADIACAO GLOBAL (Kj/m²)",
}
