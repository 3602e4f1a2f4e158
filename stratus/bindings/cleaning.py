"""Cleaning, projection and filter operators on the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratus.bindings import R, query
from stratus.bindings.fixtures import gappy, gappy_sql, obs, obs_sql, scores, scores_sql, table
from stratus.functions.numeric import clamp_non_negative, round_half_even
from stratus.operators import clean, features

TEXT_VALUE = (
    "CASE WHEN event_id % 11 = 0 THEN 'n/d' WHEN event_id % 13 = 0 THEN 'inf' WHEN event_id % 17 = 0 THEN 'NaN' "
    "WHEN event_id % 19 = 0 THEN '' ELSE concat(' ', replace(CAST(value AS VARCHAR), '.', ','), ' ') END"
)
SPECIAL_VALUE = (
    "CASE WHEN event_id % 13 = 0 THEN CAST('inf' AS DOUBLE) WHEN event_id % 17 = 0 THEN CAST('-inf' AS DOUBLE) "
    "WHEN event_id % 19 = 0 THEN CAST('NaN' AS DOUBLE) ELSE value END"
)
MEASURES = ["temp", "humidity", "pressure", "rain_mm", "radiation"]


@query(
    "to_numeric",
    f"""
SELECT event_id, {R("CASE WHEN isnan(x) OR isinf(x) THEN NULL ELSE x END")} AS value
FROM (SELECT event_id, TRY_CAST(trim(replace(txt, ',', '.')) AS DOUBLE) AS x
      FROM (SELECT event_id, {TEXT_VALUE} AS txt FROM events) t) u
""",
)
def q_to_numeric(spark, sf):
    """Comma-decimal text with junk -> double."""
    ev = table(spark, sf, "events").selectExpr("event_id", f"{TEXT_VALUE.replace('VARCHAR', 'STRING')} AS value")
    return clean.to_numeric(ev, exclude=["event_id"])


@query(
    "inf_to_null",
    f"""
SELECT event_id, {R("CASE WHEN isnan(v) OR isinf(v) THEN NULL ELSE v END")} AS value
FROM (SELECT event_id, {SPECIAL_VALUE} AS v FROM events) t
""",
)
def q_inf_to_null(spark, sf):
    ev = table(spark, sf, "events").selectExpr("event_id", f"{SPECIAL_VALUE} AS value")
    return clean.inf_to_null(ev, ["value"])


def _sigma_sql(cols, k=10):
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in cols)
    outs = ", ".join(
        R(f"CASE WHEN s_{c} IS NOT NULL AND s_{c} > 0 AND abs({c} - m_{c}) > {k} * s_{c} THEN NULL ELSE {c} END") + f" AS {c}" for c in cols
    )
    return f"SELECT event_id, {outs} FROM {obs_sql()} o, (SELECT {stats} FROM {obs_sql()} o2) st"


@query("drop_outliers_sigma", _sigma_sql(["temp", "rain_mm", "radiation", "wind_speed"]))
def q_drop_outliers_sigma(spark, sf):
    """Values beyond 10 standard deviations -> NULL (reference default k=10)."""
    o = obs(spark, sf).select("event_id", "temp", "rain_mm", "radiation", "wind_speed")
    return clean.drop_outliers_sigma(o, ["temp", "rain_mm", "radiation", "wind_speed"])


def _iqr_sql(tbl, cols):
    parts = []
    for c in cols:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"""SELECT '{c}' AS "column",
       CAST(count(*) FILTER (WHERE x < lo OR x > hi) AS BIGINT) AS n_outliers,
       {R("round(100.0 * count(*) FILTER (WHERE x < lo OR x > hi) / count(*), 2)")} AS pct_outliers,
       {R("round(first(lo), 2)")} AS lower_bound, {R("round(first(hi), 2)")} AS upper_bound
FROM (SELECT {x} AS x FROM {tbl}) t,
     (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi
      FROM (SELECT quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.75) AS q3 FROM {tbl}) q) b"""
        )
    return "\nUNION ALL\n".join(parts)


IQR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("outliers_iqr", _iqr_sql("lineitem", IQR_COLS))
def q_outliers_iqr(spark, sf):
    return clean.outliers_iqr(table(spark, sf, "lineitem"), IQR_COLS)


def _gcols():
    return ", ".join(f"{R(c)} AS {c}" for c in MEASURES)


@query("drop_null_rows", f"SELECT event_id, {_gcols()} FROM {gappy_sql()} g WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in MEASURES))
def q_drop_null_rows(spark, sf):
    return clean.drop_null_rows(gappy(spark, sf).select("event_id", *MEASURES))


@query(
    "drop_null_thresh",
    f"SELECT event_id, {_gcols()} FROM {gappy_sql()} g WHERE "
    + " + ".join(f"(CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END)" for c in MEASURES)
    + " >= 3",
)
def q_drop_null_thresh(spark, sf):
    return clean.drop_null_thresh(gappy(spark, sf).select("event_id", *MEASURES), thresh=3, subset=MEASURES)


SPARSE_FEATURES = ["temp", "humidity", "pressure", "radiation"]


@query(
    "drop_sparse_rows",
    f"SELECT event_id, {_gcols()} FROM {gappy_sql()} g WHERE rain_mm IS NOT NULL AND "
    + " + ".join(f"(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)" for c in SPARSE_FEATURES)
    + " <= 2",
)
def q_drop_sparse_rows(spark, sf):
    """Rows with > 50 % missing features or a missing target are dropped."""
    return clean.drop_sparse_rows(gappy(spark, sf).select("event_id", *MEASURES), SPARSE_FEATURES, ["rain_mm"])


_COMPLETE_KEEP = ["event_id", "station_id", "wind_speed", "temp_max", "temp_min", "dew_point", "humidity_max", "humidity_min", "pressure_max", "pressure_min", "temp", "humidity", "pressure", "rain_mm"]


@query(
    "select_complete_columns",
    "SELECT "
    + ", ".join(R(c) + f" AS {c}" if c not in ("event_id", "station_id") else c for c in _COMPLETE_KEEP)
    + ", CAST(CASE WHEN rain_mm > 0 THEN 1 ELSE 0 END AS BIGINT) AS Chuva"
    + f" FROM {gappy_sql()} g",
)
def q_select_complete_columns(spark, sf):
    """Numeric columns with ≥ 70 % values (radiation has 40 %, dropped) + target."""
    g = features.rain_label(gappy(spark, sf), "rain_mm")
    return clean.select_complete_columns(g, 0.70, target="Chuva")


@query("select_numeric", f"SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size, {R('p_retailprice')} AS p_retailprice FROM part")
def q_select_numeric(spark, sf):
    return clean.select_numeric(table(spark, sf, "part"))


@query("series_projection", f"SELECT ts AS time, {R('temp')} AS value FROM {obs_sql()} o")
def q_series_projection(spark, sf):
    return clean.series_projection(obs(spark, sf), "temp", ts="ts")


@query(
    "rain_label",
    f"SELECT event_id, {R('rain_mm')} AS rain_mm, CAST(coalesce(CASE WHEN rain_mm > 0 THEN 1 ELSE 0 END, 0) AS BIGINT) AS Chuva FROM {gappy_sql()} g",
)
def q_rain_label(spark, sf):
    """Label 1 when rain > 0; a missing amount counts as dry."""
    return features.rain_label(gappy(spark, sf).select("event_id", "rain_mm"), "rain_mm")


ALIGN_FEATURES = ["p_size", "p_retailprice", "p_weight", "p_partkey"]
ALIGN_MEDIANS = {"p_retailprice": 1234.5}


@query(
    "align_features",
    f"""SELECT {R('CAST(p_size AS DOUBLE)')} AS p_size,
       {R('coalesce(CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_retailprice END, 1234.5)')} AS p_retailprice,
       {R('0.0')} AS p_weight, {R('CAST(p_partkey AS DOUBLE)')} AS p_partkey FROM part""",
)
def q_align_features(spark, sf):
    """Missing feature -> 0, extras dropped, gaps -> training median, order kept."""
    p = table(spark, sf, "part").withColumn("p_retailprice", F.expr("CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_retailprice END"))
    return clean.align_features(p, ALIGN_FEATURES, ALIGN_MEDIANS)


@query(
    "threshold_decision",
    f"SELECT event_id, {R('prob')} AS prob_chuva, CAST(CASE WHEN prob >= 0.5 THEN 1 ELSE 0 END AS BIGINT) AS vai_chover, {R('(prob - 0.5) * 100.0')} AS delta_pp FROM {scores_sql()} s",
)
def q_threshold_decision(spark, sf):
    s = scores(spark, sf).select("event_id", F.col("prob").alias("prob_chuva"))
    return clean.threshold_decision(s, "prob_chuva", 0.5)


@query("clamp_non_negative", f"SELECT event_id, {R('greatest(value - 50, 0.0)')} AS amount FROM events")
def q_clamp_non_negative(spark, sf):
    ev = table(spark, sf, "events")
    return ev.select("event_id", clamp_non_negative(F.col("value") - 50).alias("amount"))


ROUND_INPUT = "CAST(event_id % 8 AS DOUBLE) / 8 + CAST(event_id % 3 AS DOUBLE)"


@query("rounding", f"SELECT event_id, {R(f'round_even({ROUND_INPUT}, 2)')} AS rounded FROM events")
def q_rounding(spark, sf):
    """Banker's rounding of report figures (eighths hit the .x25/.x75 ties)."""
    ev = table(spark, sf, "events")
    return ev.select("event_id", round_half_even(F.expr(ROUND_INPUT), 2).alias("rounded"))


_FEATURE_INPUT = ["event_id", "station_id", "event_type", "rain_mm", "temp", "humidity", "pressure", "radiation", "wind_speed"]


@query(
    "select_features",
    "SELECT event_id, station_id, event_type, "
    + ", ".join(f"{R(c)} AS {c}" for c in ["temp", "humidity", "pressure", "radiation", "wind_speed"])
    + f" FROM {obs_sql()} o",
)
def q_select_features(spark, sf):
    """Model inputs: every column except time columns and the targets (label and amount)."""
    df = features.rain_label(obs(spark, sf).select("ts", *_FEATURE_INPUT), "rain_mm").withColumnRenamed("ts", "datetime")
    return df.select(*clean.select_features(df, targets=("Chuva", "rain_mm")))


@query(
    "rename_drop_temp",
    """SELECT event_id, d AS Data, h AS Hora, try_strptime(d || ' ' || h, '%Y/%m/%d %H%M') AS datetime
FROM (SELECT event_id, strftime(ts, '%Y/%m/%d') AS d, strftime(ts, '%H%M') AS h FROM events) t""",
)
def q_rename_drop_temp(spark, sf):
    """Helper columns (parsed date, padded hour) are added, combined and dropped again."""
    ev = table(spark, sf, "events").select("event_id", F.date_format("ts", "yyyy/MM/dd").alias("Data"), F.date_format("ts", "HHmm").alias("Hora"))
    tmp = ev.withColumns({"data_temp": F.col("Data"), "hora_temp": F.lpad(F.col("Hora"), 4, "0")})
    from stratus.functions.calendar import build_timestamp

    return tmp.withColumn("datetime", build_timestamp(F.col("data_temp"), F.col("hora_temp"))).drop("data_temp", "hora_temp")
