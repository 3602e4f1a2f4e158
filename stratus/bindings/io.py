"""Readers, writers and preprocessing composites, as round trips through the shared folder.

Station files are derived from ``events`` (station = ``user_id % 3``): Latin-1 text, a
three-line preamble, a ``Data``/``Hora`` header with accented measure names and a
trailing ``;``, decimal commas, ``'HHmm UTC'`` hours, one junk line per file, an empty
temperature cell every 20 rows; layout 1 swaps two columns, layout 2 has no humidity, and one
file has no header.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratus.bindings import R, query
from stratus.bindings.fixtures import OBS_COLUMNS, gappy, gappy_sql, obs, obs_sql, scores, scores_sql, table
from stratus.bindings.learning import ENCODER_SQL, _categories
from stratus.bindings.profiling import labelled, labelled_sql
from stratus.functions.calendar import build_timestamp
from stratus.functions.roles import feature_diff, resolve_measure_columns, resolve_time_columns
from stratus.operators import clean, encode, features
from stratus.plans import preprocess
from stratus.session import scratch_path
from stratus.sources import files, models as persist
from stratus.sources.station_csv import scan_station_csv

# Header texts of the station-file layout.
H_DATE, H_HOUR, H_ID = "Data", "Hora UTC", "ID"
H_RAIN = "PRECIPITAÇÃO TOTAL, HORÁRIO (mm)"
H_TEMP = "TEMPERATURA DO AR - BULBO SECO, HORARIA (°C)"
H_HUM = "UMIDADE RELATIVA DO AR, HORARIA (%)"
FILE_LAYOUT = {0: [H_RAIN, H_TEMP, H_HUM], 1: [H_RAIN, H_HUM, H_TEMP], 2: [H_RAIN, H_TEMP]}
PREAMBLE = ["REGIÃO:;SE", "ESTAÇÃO:;{f}", "DATA DE FUNDAÇÃO:;2000-01-01"]


def _comma(c):
    return F.regexp_replace(c.cast("string"), r"\.", ",")


def write_station_files(spark: SparkSession, sf: str, junk: bool = True, extra: bool = False) -> str:
    """Station files (``user_id % 3`` gives the layout) under a fresh shared folder.

    Every partition of ``events`` is written as files of its own, each with the preamble and the
    header of its layout, so the writing is spread.  With ``junk`` each file ends with a line that
    is no observation, and one more file has no header at all.  With ``extra`` every 50th event's line
    has a value beyond the header's fields.
    """
    path = scratch_path(spark, "stations")
    ev = table(spark, sf, "events")
    values = {
        H_RAIN: _comma(F.expr("CASE WHEN value > 60 THEN (value - 60) / 10 ELSE CAST(0 AS DOUBLE) END")),
        H_TEMP: F.when(F.col("event_id") % 20 == 0, F.lit("")).otherwise(_comma(F.expr("15 + value / 20"))),
        H_HUM: _comma(F.expr("CAST(40 + (event_id * 13) % 60 AS DOUBLE)")),
    }
    part, layout = F.spark_partition_id(), (F.col("user_id") % 3).cast("int")
    heads, lines = [], []
    for f, columns in FILE_LAYOUT.items():
        fields = [F.date_format("ts", "yyyy/MM/dd"), F.concat(F.date_format("ts", "HHmm"), F.lit(" UTC")), F.col("event_id").cast("string")]
        more = F.when((F.col("event_id") % 50 == 0) & F.lit(extra), "9;9;").otherwise("")
        lines.append(F.when(layout == f, F.concat(F.concat_ws(";", *fields, *[values[h] for h in columns]), F.lit(";"), more)))
        head = [*[p.format(f=f"STATION {f}") for p in PREAMBLE], ";".join([H_DATE, H_HOUR, H_ID, *columns]) + ";"]
        heads.append(F.when(F.col("layout") == f, F.array(*map(F.lit, head))))
    rows = ev.select(part.alias("part"), layout.alias("layout"), F.lit(100).alias("no"), F.coalesce(*lines).alias("line"))
    each = rows.select("part", "layout").distinct()
    extra = [each.select("part", "layout", F.posexplode(F.coalesce(*heads)).alias("no", "line"))]
    if junk:
        extra.append(each.select("part", "layout", F.lit(200).alias("no"), F.lit("fim do arquivo;;;x").alias("line")))
        extra.append(spark.range(1).select(F.lit(-1).alias("part"), F.lit(9).alias("layout"), F.lit(0).alias("no"), F.lit("2024/01/01;0000 UTC;-1;1;2;3;").alias("line")))
    for e in extra:
        rows = rows.unionByName(e)
    # one file per (part, layout): the header first, the junk last
    ordered = rows.repartition("part", "layout").sortWithinPartitions("layout", "part", "no")
    writer = ordered.select("layout", "part", "line").write.partitionBy("layout", "part").option("sep", "\x01").option("quote", "").option("escape", "")
    writer.option("encoding", "ISO-8859-1").csv(path)
    return path


def _engine_view(raw: DataFrame) -> DataFrame:
    """Station rows -> (event_id, datetime, rain_mm, temp, humidity) via role resolution."""
    times = resolve_time_columns(raw.columns)
    roles = resolve_measure_columns(raw.columns)
    num = clean.to_numeric(raw, exclude=[times["data"], times["hora"], "source_file"])
    cols = [
        F.col(H_ID).cast("long").alias("event_id"),  # the junk line has none
        build_timestamp(F.col(times["data"]), F.col(times["hora"])).alias("datetime"),
    ]
    for role in ("rain_mm", "temp", "humidity"):
        cols.append((F.col(roles[role]) if role in roles else F.lit(None).cast("double")).alias(role))
    return num.select(*cols).where("event_id is not null")


STATION_SQL = f"""SELECT event_id, date_trunc('minute', ts) AS datetime,
       {R("CASE WHEN value > 60 THEN (value - 60) / 10 ELSE 0.0 END")} AS rain_mm,
       {R("CASE WHEN event_id % 20 = 0 THEN NULL ELSE 15 + value / 20 END")} AS temp,
       {R("CASE WHEN user_id % 3 = 2 THEN NULL ELSE CAST(40 + (event_id * 13) % 60 AS DOUBLE) END")} AS humidity
FROM events"""


@query("scan_station_csv", STATION_SQL)
def q_scan_station_csv(spark, sf):
    """Station files of three layouts, read back in one scan (per-file headers merged)."""
    path = write_station_files(spark, sf)
    return _engine_view(scan_station_csv(spark, path, recursive=True, on_bad_file="skip"))


@query("scan_glob_union", STATION_SQL)
def q_scan_glob_union(spark, sf):
    """Every station file below the folder, the one without a header left out, stacked by column name."""
    path = write_station_files(spark, sf)
    return _engine_view(files.scan_glob_union(spark, path, path_glob="PART-*.CSV"))


@query(
    "scan_glob_union_quarantine",
    f"""SELECT event_id, 'extra fields' AS reason, CAST(NULL AS DOUBLE) AS temp FROM events WHERE event_id % 50 = 0
UNION ALL SELECT -1, 'no header', NULL
UNION ALL SELECT event_id, 'row', {R("CASE WHEN event_id % 20 = 0 THEN NULL ELSE 15 + value / 20 END")} FROM events WHERE event_id % 50 <> 0""",
)
def q_scan_glob_union_quarantine(spark, sf):
    """Where each line of the stacked files went: a row, or the quarantine with its reason."""
    read = files.read_glob_union(spark, write_station_files(spark, sf, extra=True), path_glob="PART-*.CSV")
    rows = _engine_view(read.rows).select("event_id", F.lit("row").alias("reason"), "temp")
    held = read.quarantine.select(F.split("text", ";")[2].cast("long").alias("event_id"), "reason", F.lit(None).cast("double").alias("temp"))
    return rows.unionByName(held)


@query(
    "resolve_time_columns",
    "SELECT 'data' AS role, 'Data' AS \"column\", CAST(count(*) AS BIGINT) AS n_rows FROM events UNION ALL SELECT 'hora', 'Hora UTC', CAST(count(*) AS BIGINT) FROM events",
)
def q_resolve_time_columns(spark, sf):
    """Date / hour columns found by keyword in the scanned headers, with the rows read."""
    raw = scan_station_csv(spark, write_station_files(spark, sf, junk=False), recursive=True)
    found = resolve_time_columns(raw.columns)
    n = raw.agg(F.count(F.lit(1)).alias("n_rows"))
    return n.select(F.inline(F.array(*[F.struct(F.lit(r).alias("role"), F.lit(c).alias("column")) for r, c in found.items()])), F.col("n_rows").cast("long"))


@query(
    "resolve_measure_columns",
    "\nUNION ALL\n".join(
        f"SELECT '{r}' AS role, '{c}' AS \"column\", CAST(count(*) AS BIGINT) AS n_rows FROM events"
        for r, c in [("rain_mm", H_RAIN), ("temp", H_TEMP), ("humidity", H_HUM)]
    ),
)
def q_resolve_measure_columns(spark, sf):
    """Measure roles found by accent-insensitive keywords in the scanned headers."""
    raw = scan_station_csv(spark, write_station_files(spark, sf, junk=False), recursive=True)
    found = resolve_measure_columns(raw.columns)
    n = raw.agg(F.count(F.lit(1)).alias("n_rows"))
    return n.select(F.inline(F.array(*[F.struct(F.lit(r).alias("role"), F.lit(c).alias("column")) for r, c in found.items()])), F.col("n_rows").cast("long"))


STATION_PATTERN = r"layout=(\d+)"
FEATURE_LAGS, FEATURE_WINDOWS = [1, 3, 6], [3, 6, 12]


def _processed_sql():
    """The processed table of the station files: station = ``user_id % 3``, whole minutes, order (time, ID).

    Humidity is missing at station 2, so all its rows lack lags and go; no value lies 10 sigma out."""
    measures = {H_ID: "id", H_RAIN: "rain", H_TEMP: "temp", H_HUM: "hum"}
    base = """SELECT CAST(event_id AS DOUBLE) AS id, user_id % 3 AS st, date_trunc('minute', ts) AS dt,
       CASE WHEN value > 60 THEN (value - 60) / 10 ELSE 0.0 END AS rain, CASE WHEN event_id % 20 = 0 THEN NULL ELSE 15 + value / 20 END AS temp0,
       CASE WHEN user_id % 3 = 2 THEN NULL ELSE CAST(40 + (event_id * 13) % 60 AS DOUBLE) END AS hum FROM events"""
    numbered = f"SELECT *, row_number() OVER (PARTITION BY st ORDER BY dt, id) AS rn FROM ({base}) b"
    near = """SELECT *, last_value(CASE WHEN temp0 IS NOT NULL THEN rn END IGNORE NULLS) OVER back AS pr, last_value(temp0 IGNORE NULLS) OVER back AS pv,
       first_value(CASE WHEN temp0 IS NOT NULL THEN rn END IGNORE NULLS) OVER ahead AS nr, first_value(temp0 IGNORE NULLS) OVER ahead AS nv
       FROM numbered WINDOW back AS (PARTITION BY st ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
       ahead AS (PARTITION BY st ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"""
    filled = """SELECT * EXCLUDE (temp0), CASE WHEN temp0 IS NOT NULL THEN temp0
       WHEN pr IS NOT NULL AND nr IS NOT NULL AND (rn - pr <= 3 OR nr - rn <= 3) THEN pv + (nv - pv) * (rn - pr) / (nr - pr)
       WHEN nr IS NULL AND rn - pr <= 3 THEN pv WHEN pr IS NULL AND nr - rn <= 3 THEN nv END AS temp FROM near"""
    made = {}
    for h, c in ((H_TEMP, "temp"), (H_HUM, "hum")):
        made |= {f"{h}_lag_{n}h": f"lag({c}, {n}) OVER (PARTITION BY st ORDER BY rn)" for n in FEATURE_LAGS}
        for n in FEATURE_WINDOWS:
            frame = f"OVER (PARTITION BY st ORDER BY rn ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
            made |= {f"{h}_rolling_mean_{n}h": f"avg({c}) {frame}", f"{h}_rolling_std_{n}h": f"stddev_samp({c}) {frame}"}
    windowed = "SELECT *, " + ", ".join(f"{e} AS w{i}" for i, e in enumerate(made.values())) + " FROM filled"
    season = "CASE WHEN month(dt) IN (12, 1, 2) THEN 'verao' WHEN month(dt) IN (3, 4, 5) THEN 'outono' WHEN month(dt) IN (6, 7, 8) THEN 'inverno' ELSE 'primavera' END"
    period = "CASE WHEN hour(dt) >= 6 AND hour(dt) < 12 THEN 'manha' WHEN hour(dt) >= 12 AND hour(dt) < 18 THEN 'tarde' WHEN hour(dt) >= 18 THEN 'noite' ELSE 'madrugada' END"
    out = {
        "Data": "strftime(dt, '%Y/%m/%d')", "Hora UTC": "strftime(dt, '%H%M UTC')", "station": "CAST(st AS VARCHAR)", "datetime": "dt",
        **{h: R(c) for h, c in measures.items()}, "Chuva": "CAST(CASE WHEN rain > 0 THEN 1 ELSE 0 END AS BIGINT)",
        **{n: f"CAST({e} AS BIGINT)" for n, e in [("ano", "year(dt)"), ("mes", "month(dt)"), ("dia", "day(dt)"), ("hora", "hour(dt)"), ("dia_semana", "isodow(dt) - 1"),
            ("dia_ano", "dayofyear(dt)"), ("semana_ano", "week(dt)"), ("fim_semana", "CASE WHEN isodow(dt) >= 6 THEN 1 ELSE 0 END")]},
        **{f"hora_{f}": R(f"{f}(2 * pi() * hour(dt) / 24)") for f in ("sin", "cos")}, **{f"mes_{f}": R(f"{f}(2 * pi() * month(dt) / 12)") for f in ("sin", "cos")},
        "estacao": season, "periodo_dia": period, "indice_desconforto": R("temp - 0.55 * (1.0 - 0.01 * hum) * (temp - 14.5)"), **{n: R(f"w{i}") for i, n in enumerate(made)},
    }
    present = " AND ".join(f"w{i} IS NOT NULL" for i in range(len(made)))
    cols = ", ".join(f'{e} AS "{n}"' for n, e in out.items())
    return f"WITH numbered AS ({numbered}), near AS ({near}), filled AS ({filled}), windowed AS ({windowed}) SELECT {cols} FROM windowed WHERE {present}"


PROCESSED_SQL = _processed_sql()


def _processed(spark, sf):
    return preprocess.preprocess_file(
        spark, write_station_files(spark, sf, junk=False), create_lags=True, create_rolling=True, station_pattern=STATION_PATTERN, recursive=True, tie_break=[H_ID]
    ).drop("source_file")


@query("fit_transform", PROCESSED_SQL)
def q_fit_transform(spark, sf):
    """Station files -> cleaned, interpolated, labelled, feature-enriched rows with lags and rolling stats."""
    raw = scan_station_csv(spark, write_station_files(spark, sf, junk=False), recursive=True, station_column="station", station_pattern=STATION_PATTERN)
    return preprocess.fit_transform(raw, create_lags=True, create_rolling=True, tie_break=[H_ID]).drop("source_file")


@query("preprocess_file", PROCESSED_SQL)
def q_preprocess_file(spark, sf):
    """Read, preprocess and write the processed table as CSV; returns the processed rows read back."""
    out_path = scratch_path(spark, "processed")
    df = _processed(spark, sf)
    files.sink_csv(df, out_path)
    return files.scan_csv(spark, out_path, schema=df.schema)


ADDED = [
    "datetime", "Chuva", "ano", "mes", "dia", "hora", "dia_semana", "dia_ano", "semana_ano", "hora_sin", "hora_cos", "mes_sin", "mes_cos", "estacao", "periodo_dia", "fim_semana",
    "indice_desconforto", *[f"{h}_lag_{n}h" for h in (H_TEMP, H_HUM) for n in FEATURE_LAGS],
    *[f"{h}_rolling_{k}_{n}h" for h in (H_TEMP, H_HUM) for n in FEATURE_WINDOWS for k in ("mean", "std")],
]


@query("feature_diff", f"SELECT feature, CAST(n AS BIGINT) AS n_rows FROM (SELECT count(*) AS n FROM ({PROCESSED_SQL}) p) c, (VALUES " + ", ".join(f"('{c}')" for c in ADDED) + ") v(feature)")
def q_feature_diff(spark, sf):
    """Columns the preprocessing adds to the raw station columns, with the rows that have them."""
    raw = scan_station_csv(spark, write_station_files(spark, sf, junk=False), recursive=True, station_column="station", station_pattern=STATION_PATTERN)
    out = preprocess.fit_transform(raw, create_lags=True, create_rolling=True, tie_break=[H_ID])
    added = feature_diff(raw.columns, out.columns)
    n = out.agg(F.count(F.lit(1)).alias("n_rows"))
    return n.select(F.explode(F.array(*[F.lit(c) for c in added])).alias("feature"), "n_rows")


OBS_SCHEMA = (
    "event_id bigint, station_id bigint, ts timestamp_ntz, event_type string, rain_mm double, temp double, humidity double, "
    "pressure double, radiation double, wind_speed double, temp_max double, temp_min double, dew_point double, "
    "humidity_max double, humidity_min double, pressure_max double, pressure_min double"
)
OBS_DOUBLES = ["rain_mm", "temp", "humidity", "pressure", "radiation", "wind_speed", "temp_max", "temp_min", "dew_point", "humidity_max", "humidity_min", "pressure_max", "pressure_min"]


@query("scan_csv", "SELECT event_id, station_id, ts, event_type, " + ", ".join(f"{R(c)} AS {c}" for c in OBS_DOUBLES) + f" FROM {obs_sql()} o")
def q_scan_csv(spark, sf):
    """Processed table written as CSV and read back with an explicit schema."""
    path = scratch_path(spark, "obs-csv")
    files.sink_csv(obs(spark, sf), path)
    return files.scan_csv(spark, path, schema=OBS_SCHEMA)


@query("sink_csv", f"SELECT event_id, {R('prob')} AS prob, CAST(y_pred AS BIGINT) AS y_pred FROM {scores_sql()} s")
def q_sink_csv(spark, sf):
    """Predictions written as UTF-8 CSV with a header (read back to check)."""
    path = scratch_path(spark, "pred-csv")
    files.sink_csv(scores(spark, sf).select("event_id", "prob", "y_pred"), path)
    return files.scan_csv(spark, path, schema="event_id bigint, prob double, y_pred int")


@query("sink_parquet", f"SELECT event_id, station_id, ts, {R('temp')} AS temp, CAST(year(ts) AS BIGINT) AS year FROM {obs_sql()} o")
def q_sink_parquet(spark, sf):
    """Processed rows as Parquet partitioned by year (read back with partition discovery)."""
    path = scratch_path(spark, "obs-parquet")
    files.sink_parquet(obs(spark, sf).select("event_id", "station_id", "ts", "temp", F.year("ts").alias("year")), path, ["year"])
    return spark.read.parquet(path)


def _report_sql():
    """The report's features by section, each with the expression that has its values."""
    made = {
        "temporal": {
            "ano": "year(ts)", "mes": "month(ts)", "dia": "day(ts)", "hora": "hour(ts)", "dia_semana": "isodow(ts)", "dia_ano": "dayofyear(ts)", "semana_ano": "week(ts)",
            "hora_sin": "hour(ts)", "hora_cos": "hour(ts)", "mes_sin": "month(ts)", "mes_cos": "month(ts)", "estacao": "month(ts)", "periodo_dia": "hour(ts)", "fim_semana": "isodow(ts)",
        },
        "weather": {
            "amplitude_termica": "temp_max - temp_min", "spread_temp_orvalho": "temp - dew_point", "variacao_pressao": "pressure_max - pressure_min",
            "variacao_umidade": "humidity_max - humidity_min", "indice_desconforto": "temp + humidity", "radiacao_norm": "radiation",
        },
        "lag": {"temp_lag_3h": "lag(temp, 3) OVER w"},
        "rolling": {f"temp_rolling_{k}_6h": f"{f}(temp) OVER (w ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)" for k, f in (("mean", "avg"), ("std", "stddev_samp"))},
        "measure": {c: c for c in OBS_COLUMNS},
    }
    items = [(section, i, name, names[name]) for section, names in made.items() for i, name in enumerate(sorted(names), 1)]
    columns = ", ".join(f"{e} AS x{k}" for k, (*_, e) in enumerate(items))
    table = f"(SELECT CASE WHEN rain_mm > 0 THEN 1 ELSE 0 END AS y, {columns} FROM {gappy_sql()} g WINDOW w AS (PARTITION BY station_id ORDER BY ts, event_id)) t"
    rows = [f"SELECT '{s}' AS section, CAST({i} AS BIGINT) AS position, '{n}' AS item, {R(f'100.0 * count(x{k}) / count(*)')} AS value FROM t" for k, (s, i, n, _) in enumerate(items)]
    figures = [("n_rows", "count(*)"), ("n_columns", f"max({len(items) + 1})"), ("rain_rate", "100.0 * avg(y)")]
    rows += [f"SELECT 'summary', CAST({i} AS BIGINT), '{n}', {R(e)} FROM t" for i, (n, e) in enumerate(figures, 1)]
    return f"WITH t AS MATERIALIZED (SELECT * FROM {table}) " + "\nUNION ALL ".join(rows)


@query("sink_feature_report", _report_sql())
def q_sink_feature_report(spark, sf):
    """The report of an enriched table with gaps (figures, and every feature by group with its share of values),
    written as JSON and read back."""
    o = features.rain_label(gappy(spark, sf), "rain_mm")
    o = features.weather_features(features.calendar_features(o, "ts"))
    o = features.lag_and_rolling(o, ["temp"], [3], ["temp"], [6], key=["station_id"], order=["ts", "event_id"])
    path = scratch_path(spark, "feature-report")
    files.sink_json(preprocess.feature_report(o), path)
    return spark.read.schema("section string, position bigint, item string, value double").json(path)


@query("save_encoders", ENCODER_SQL)
def q_save_encoders(spark, sf):
    """Encoder table written as Parquet and read back."""
    path = scratch_path(spark, "encoders")
    persist.save_encoders(encode.label_encode_fit(_categories(spark, sf), ["periodo_dia", "event_type"]), path, spark)
    return spark.read.parquet(path)
