"""Profiling, rate and distribution operators on the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratus.bindings import R, query
from stratus.bindings.fixtures import gappy, gappy_sql, obs, obs_sql, scores, scores_sql, table
from stratus.operators import features, profile

LABEL_SQL = "CAST(CASE WHEN rain_mm > 0 THEN 1 ELSE 0 END AS INT)"
ORDER_LABEL = "CAST(CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END AS INT)"
SEASON_SQL = (
    "CASE WHEN m IN (12, 1, 2) THEN 'verao' WHEN m IN (3, 4, 5) THEN 'outono' "
    "WHEN m IN (6, 7, 8) THEN 'inverno' ELSE 'primavera' END"
)


def labelled(spark, sf):
    return features.rain_label(obs(spark, sf), "rain_mm")


def labelled_sql() -> str:
    return f"(SELECT *, {LABEL_SQL} AS Chuva FROM {obs_sql()} o)"


def orders_labelled(spark, sf):
    return table(spark, sf, "orders").withColumn("Chuva", F.expr(ORDER_LABEL))


# --- rates ---------------------------------------------------------------------------


@query(
    "rain_rate_by_hour",
    f"""SELECT CAST(hour(ts) AS BIGINT) AS hora, CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(Chuva) AS BIGINT) AS n_events,
       {R("avg(CAST(Chuva AS DOUBLE)) * 100.0")} AS rate
FROM {labelled_sql()} l GROUP BY hour(ts)""",
)
def q_rain_rate_by_hour(spark, sf):
    """Flagship: label -> hour of day -> event rate."""
    df = features.time_parts(labelled(spark, sf), "ts")
    return profile.rate_by(df, "hora")


@query(
    "rain_rate",
    f"SELECT {R('avg(CAST(Chuva AS DOUBLE)) * 100.0')} AS rate, CAST(sum(Chuva) AS BIGINT) AS n_events, CAST(count(*) AS BIGINT) AS n_rows FROM {labelled_sql()} l",
)
def q_rain_rate(spark, sf):
    return profile.rain_rate(labelled(spark, sf))


def _rate_sql(group_expr, name, src):
    return f"""SELECT {group_expr} AS {name}, CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(Chuva) AS BIGINT) AS n_events,
       {R("avg(CAST(Chuva AS DOUBLE)) * 100.0")} AS rate FROM {src} GROUP BY {group_expr}"""


ORDERS_L = f"(SELECT *, {ORDER_LABEL} AS Chuva FROM orders) o"


@query("rain_rate_by_month", _rate_sql("CAST(month(o_orderdate) AS BIGINT)", "mes", ORDERS_L))
def q_rain_rate_by_month(spark, sf):
    df = features.time_parts(orders_labelled(spark, sf), "o_orderdate")
    return profile.rate_by(df, "mes")


@query("rain_rate_by_weekday", _rate_sql("CAST(isodow(o_orderdate) - 1 AS BIGINT)", "dia_semana", ORDERS_L))
def q_rain_rate_by_weekday(spark, sf):
    df = features.time_parts(orders_labelled(spark, sf), "o_orderdate")
    return profile.rate_by(df, "dia_semana")


@query(
    "rain_rate_by_season",
    _rate_sql("estacao", "estacao", f"(SELECT *, {SEASON_SQL} AS estacao FROM (SELECT *, month(o_orderdate) AS m, {ORDER_LABEL} AS Chuva FROM orders) x) o"),
)
def q_rain_rate_by_season(spark, sf):
    df = features.calendar_features(orders_labelled(spark, sf), "o_orderdate")
    return profile.rate_by(df, "estacao")


@query(
    "group_mean_diff",
    f"""SELECT CAST(count(temp) AS BIGINT) AS n_rows, {R("avg(temp) FILTER (WHERE Chuva = 0)")} AS mean_0,
       {R("avg(temp) FILTER (WHERE Chuva = 1)")} AS mean_1,
       {R("abs(avg(temp) FILTER (WHERE Chuva = 0) - avg(temp) FILTER (WHERE Chuva = 1))")} AS abs_diff
FROM (SELECT temp, CAST(CASE WHEN rain_mm > 0 THEN 1 ELSE 0 END AS INT) AS Chuva FROM {gappy_sql()} g) t""",
)
def q_group_mean_diff(spark, sf):
    """Mean temperature on dry vs rainy rows (gappy temperature)."""
    return profile.group_mean_diff(features.rain_label(gappy(spark, sf), "rain_mm"), "temp")


# --- per-column profiles --------------------------------------------------------------

PART_COLS = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
PART_TYPES = {"p_partkey": "bigint", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "int", "p_retailprice": "double"}


def _smallest3(c):
    # three smallest distinct non-null values, as text joined by ', '
    return f"(SELECT string_agg(CAST(v AS VARCHAR), ', ' ORDER BY v) FROM (SELECT DISTINCT {c} AS v FROM part WHERE {c} IS NOT NULL ORDER BY v LIMIT 3) s)"


@query(
    "profile_columns",
    "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS "column", '{PART_TYPES[c]}' AS dtype, CAST(count(*) - count({c}) AS BIGINT) AS n_null,
       {R(f"round(100.0 * (count(*) - count({c})) / count(*), 2)")} AS pct_null,
       CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct, {_smallest3(c)} AS samples FROM part"""
        for c in PART_COLS
    ),
)
def q_profile_columns(spark, sf):
    return profile.profile_columns(table(spark, sf, "part"))


CUST_TYPES = {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"}


@query(
    "column_types_table",
    "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS "column", '{t}' AS dtype, CAST(count({c}) AS BIGINT) AS non_null,
       {R(f"round(100.0 * (count(*) - count({c})) / count(*), 2)")} AS pct_null FROM customer"""
        for c, t in CUST_TYPES.items()
    ),
)
def q_column_types_table(spark, sf):
    return profile.column_types_table(table(spark, sf, "customer"))


GAPPY_COLS = ["event_id", "station_id", "ts", "event_type", "wind_speed", "temp_max", "temp_min", "dew_point", "humidity_max", "humidity_min", "pressure_max", "pressure_min", "temp", "humidity", "pressure", "rain_mm", "radiation"]


def _nulls(c):
    return f"(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)"


@query(
    "table_summary",
    f"SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST({len(GAPPY_COLS)} AS BIGINT) AS n_columns, CAST(sum({' + '.join(_nulls(c) for c in GAPPY_COLS)}) AS BIGINT) AS total_nulls FROM {gappy_sql()} g",
)
def q_table_summary(spark, sf):
    return profile.table_summary(gappy(spark, sf))


LINEITEM_TYPES = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double",
    "l_extendedprice": "double", "l_discount": "double", "l_tax": "double", "l_returnflag": "string", "l_linestatus": "string",
    "l_shipdate": "timestamp_ntz",
}


@query(
    "dtype_counts",
    "SELECT dtype, CAST(count(*) AS BIGINT) AS n_columns, CAST(sum(v) AS BIGINT) AS n_values FROM ("
    + " UNION ALL ".join(
        f"SELECT '{t}' AS dtype, count({c}) FILTER (WHERE {'NOT isnan(' + c + ')' if t == 'double' else 'TRUE'}) AS v FROM lineitem"
        for c, t in LINEITEM_TYPES.items()
    )
    + ") t GROUP BY dtype",
)
def q_dtype_counts(spark, sf):
    """Columns per type and the values they hold."""
    return profile.dtype_counts(table(spark, sf, "lineitem"))


def _smallest_n(tbl, c, n):
    return f"SELECT '{c}' AS \"column\", CAST(row_number() OVER (ORDER BY v) AS BIGINT) AS rank, CAST(v AS VARCHAR) AS value FROM (SELECT DISTINCT {c} AS v FROM {tbl} WHERE {c} IS NOT NULL ORDER BY v LIMIT {n}) s"


@query("distinct_samples", "\nUNION ALL\n".join(_smallest_n("customer", c, 5) for c in ["c_name", "c_mktsegment"]))
def q_distinct_samples(spark, sf):
    return profile.distinct_samples(table(spark, sf, "customer"))


DESCRIBE_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


@query(
    "describe",
    "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS "column", CAST(count({c}) AS BIGINT) AS count, {R(f'avg({c})')} AS mean, {R(f'stddev_samp({c})')} AS std,
       {R(f'min({c})')} AS min, {R(f'quantile_cont(CAST({c} AS DOUBLE), 0.25)')} AS p25, {R(f'quantile_cont(CAST({c} AS DOUBLE), 0.5)')} AS p50,
       {R(f'quantile_cont(CAST({c} AS DOUBLE), 0.75)')} AS p75, {R(f'max({c})')} AS max FROM lineitem"""
        for c in DESCRIBE_COLS
    ),
)
def q_describe(spark, sf):
    return profile.describe(table(spark, sf, "lineitem"), DESCRIBE_COLS)


@query(
    "null_counts",
    "SELECT * FROM (\n"
    + "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS "column", CAST(count(*) - count({c}) AS BIGINT) AS n_null, {R(f"100.0 * (count(*) - count({c})) / count(*)")} AS pct_null FROM {gappy_sql()} g"""
        for c in GAPPY_COLS
    )
    + "\n) t WHERE n_null > 0",
)
def q_null_counts(spark, sf):
    return profile.null_counts(gappy(spark, sf))


@query(
    "null_counts_top5",
    "SELECT * FROM (\n"
    + "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS "column", CAST(count(*) - count({c}) AS BIGINT) AS n_null, {R(f"100.0 * (count(*) - count({c})) / count(*)")} AS pct_null FROM {gappy_sql()} g"""
        for c in GAPPY_COLS
    )
    + '\n) t WHERE n_null > 0 ORDER BY n_null DESC, "column" LIMIT 5',
)
def q_null_counts_top5(spark, sf):
    """The five columns with the most missing values (top-k report)."""
    return profile.null_counts(gappy(spark, sf), top=5)


@query(
    "row_null_counts",
    f"""SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) FILTER (WHERE k > 0) AS BIGINT) AS rows_with_null, CAST(sum(k) AS BIGINT) AS total_nulls
FROM (SELECT {' + '.join(_nulls(c) for c in GAPPY_COLS)} AS k FROM {gappy_sql()} g) t""",
)
def q_row_null_counts(spark, sf):
    return profile.row_null_counts(gappy(spark, sf))


@query(
    "valid_counts",
    "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS "column", CAST(count({c}) AS BIGINT) AS n_valid, {R(f"100.0 * count({c}) / count(*)")} AS pct_valid FROM {gappy_sql()} g"""
        for c in GAPPY_COLS
    ),
)
def q_valid_counts(spark, sf):
    return profile.valid_counts(gappy(spark, sf))


COMPLETE_COLS = ["temp", "humidity", "pressure", "rain_mm", "radiation", "wind_speed"]


@query(
    "completeness",
    f"""SELECT {R("100.0 * count(*) FILTER (WHERE k = 0) / count(*)")} AS pct_complete_rows,
       {R(f"100.0 * sum({len(COMPLETE_COLS)} - k) / (count(*) * {len(COMPLETE_COLS)})")} AS pct_cells_valid,
       CASE WHEN 100.0 * count(*) FILTER (WHERE k = 0) / count(*) < 50 THEN 'low'
            WHEN 100.0 * count(*) FILTER (WHERE k = 0) / count(*) < 70 THEN 'moderate' ELSE 'good' END AS verdict
FROM (SELECT {' + '.join(_nulls(c) for c in COMPLETE_COLS)} AS k FROM {gappy_sql()} g) t""",
)
def q_completeness(spark, sf):
    return profile.completeness(gappy(spark, sf), COMPLETE_COLS)


@query(
    "value_counts",
    f"SELECT o_orderpriority AS value, CAST(count(*) AS BIGINT) AS n, {R('100.0 * count(*) / (SELECT count(*) FROM orders)')} AS pct FROM orders GROUP BY o_orderpriority",
)
def q_value_counts(spark, sf):
    return profile.value_counts(table(spark, sf, "orders"), "o_orderpriority")


@query(
    "class_balance",
    f"SELECT CAST(count(*) AS BIGINT) AS n_classes, {R('CAST(min(n) AS DOUBLE) / max(n)')} AS ratio, CAST(min(n) AS DOUBLE) / max(n) < 0.3 AS imbalanced FROM (SELECT Chuva, count(*) AS n FROM {labelled_sql()} l GROUP BY Chuva) c",
)
def q_class_balance(spark, sf):
    return profile.class_balance(labelled(spark, sf), "Chuva")


def _hist_sql(src, col, bins, by=None, density=False):
    grp = f"{by}, " if by else ""
    spine_src = f"(SELECT DISTINCT {by} FROM counts) c, " if by else ""
    dens = ""
    if density:
        total = f"sum(coalesce(k.count, 0)) OVER (PARTITION BY s.{by})" if by else "sum(coalesce(k.count, 0)) OVER ()"
        dens = f", {R(f'coalesce(k.count, 0) / ({total} * ((hi - lo) / {bins}))')} AS density"
    return f"""WITH v AS (SELECT {grp}CAST({col} AS DOUBLE) AS x FROM {src} WHERE {col} IS NOT NULL AND NOT isnan(CAST({col} AS DOUBLE))),
r0 AS (SELECT min(x) AS lo0, max(x) AS hi0 FROM v),
r AS (SELECT CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END AS lo, CASE WHEN lo0 = hi0 THEN hi0 + 0.5 ELSE hi0 END AS hi FROM r0),
counts AS (SELECT {grp}CAST(least(floor((x - lo) / (hi - lo) * {bins}), {bins - 1}) AS BIGINT) AS bin, count(*) AS count FROM v, r GROUP BY ALL),
spine AS (SELECT {grp}CAST(b AS BIGINT) AS bin FROM {spine_src}range(0, {bins}) t(b))
SELECT {('s.' + by + ', ') if by else ''}s.bin, {R(f'lo + s.bin * ((hi - lo) / {bins})')} AS lower, {R(f'lo + (s.bin + 1) * ((hi - lo) / {bins})')} AS upper,
       CAST(coalesce(k.count, 0) AS BIGINT) AS count{dens}
FROM spine s CROSS JOIN r LEFT JOIN counts k ON s.bin = k.bin{(' AND s.' + by + ' = k.' + by) if by else ''}"""


@query("histogram", _hist_sql("lineitem", "l_extendedprice", 50))
def q_histogram(spark, sf):
    return profile.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 50)


@query("histogram_by_class", _hist_sql(labelled_sql() + " l", "humidity", 30, by="Chuva", density=True))
def q_histogram_by_class(spark, sf):
    """Per-class density histogram (30 bins) of humidity."""
    return profile.histogram(labelled(spark, sf), "humidity", 30, by="Chuva", density=True)


def _box_sql(src, col, by=None):
    grp = f"{by}, " if by else ""
    on = f"USING ({by})" if by else "ON TRUE"
    return f"""WITH v AS (SELECT {grp}CAST({col} AS DOUBLE) AS x FROM {src} WHERE {col} IS NOT NULL),
q AS (SELECT {grp}count(*) AS n, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS med, quantile_cont(x, 0.75) AS q3 FROM v {('GROUP BY ' + by) if by else ''})
SELECT {('q.' + by + ', ') if by else ''}CAST(first(q.n) AS BIGINT) AS n, {R('first(q.q1)')} AS q1, {R('first(q.med)')} AS median, {R('first(q.q3)')} AS q3,
       {R('first(q.q3) - first(q.q1)')} AS iqr,
       {R('min(x) FILTER (WHERE x >= q.q1 - 1.5 * (q.q3 - q.q1))')} AS whisker_low,
       {R('max(x) FILTER (WHERE x <= q.q3 + 1.5 * (q.q3 - q.q1))')} AS whisker_high,
       CAST(count(*) FILTER (WHERE x < q.q1 - 1.5 * (q.q3 - q.q1) OR x > q.q3 + 1.5 * (q.q3 - q.q1)) AS BIGINT) AS n_outliers
FROM v JOIN q {on} {('GROUP BY q.' + by) if by else ''}"""


@query("box_stats", _box_sql("lineitem", "l_quantity"))
def q_box_stats(spark, sf):
    return profile.box_stats(table(spark, sf, "lineitem"), "l_quantity")


@query("box_stats_by_class", _box_sql(labelled_sql() + " l", "temp", by="Chuva"))
def q_box_stats_by_class(spark, sf):
    return profile.box_stats(labelled(spark, sf), "temp", by="Chuva")


MM_COLS = ["l_quantity", "l_extendedprice", "l_discount"]


@query(
    "mean_median",
    "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS "column", {R(f'avg({c})')} AS mean, {R(f'quantile_cont(CAST({c} AS DOUBLE), 0.5)')} AS median FROM lineitem""" for c in MM_COLS
    ),
)
def q_mean_median(spark, sf):
    return profile.mean_median(table(spark, sf, "lineitem"), MM_COLS)


CORR_COLS = ["temp", "humidity", "pressure", "rain_mm", "radiation", "temp_max"]


def _corr_expr(a, b, src_alias=""):
    xa = f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN {a} END"
    xb = f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN {b} END"
    r = f"CASE WHEN stddev_pop({xa}) * stddev_pop({xb}) = 0 THEN NULL ELSE covar_pop({xa}, {xb}) / (stddev_pop({xa}) * stddev_pop({xb})) END"
    return r, f"count({xa})"


def _corr_sql(cols, src):
    parts = []
    for a in cols:
        for b in cols:
            r, n = _corr_expr(a, b)
            parts.append(f"""SELECT '{a}' AS col_a, '{b}' AS col_b, {R(r)} AS r, CAST({n} AS BIGINT) AS n_pairs FROM {src}""")
    return "\nUNION ALL\n".join(parts)


@query("correlation_matrix", _corr_sql(CORR_COLS, gappy_sql() + " g"))
def q_correlation_matrix(spark, sf):
    return profile.correlation_matrix(gappy(spark, sf), CORR_COLS)


WIDE_COLS = [c for c in GAPPY_COLS if c not in ("ts", "event_type")] + ["phase"]


@query("correlation_matrix_wide", _corr_sql(WIDE_COLS, f"(SELECT g.*, event_id % 7 AS phase FROM {gappy_sql()} g) w"))
def q_correlation_matrix_wide(spark, sf):
    """Sixteen columns: correlated in blocks of column pairs."""
    return profile.correlation_matrix(gappy(spark, sf).withColumn("phase", F.col("event_id") % 7), WIDE_COLS)


@query(
    "top_correlations",
    "SELECT col_a, col_b, r, abs_r FROM (SELECT col_a, col_b, r, "
    + R("abs(r)")
    + " AS abs_r FROM ("
    + "\nUNION ALL\n".join(
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, {R(_corr_expr(a, b)[0])} AS r FROM {gappy_sql()} g"
        for i, a in enumerate(CORR_COLS)
        for b in CORR_COLS[i + 1 :]
    )
    + ") p WHERE r IS NOT NULL) q ORDER BY abs_r DESC, col_a, col_b LIMIT 10",
)
def q_top_correlations(spark, sf):
    """Ten strongest pairs (top-k report)."""
    return profile.top_correlations(gappy(spark, sf), CORR_COLS, 10)


TARGET_FEATURES = ["temp", "humidity", "pressure", "radiation", "wind_speed", "dew_point"]
STRENGTH_SQL = (
    "CASE WHEN abs(r) > 0.7 THEN 'muito forte' WHEN abs(r) > 0.5 THEN 'forte' WHEN abs(r) > 0.3 THEN 'moderada' "
    "WHEN abs(r) > 0.1 THEN 'fraca' ELSE 'muito fraca' END"
)


@query(
    "target_correlations",
    "SELECT feature, "
    + R("r")
    + f" AS r, {STRENGTH_SQL} AS strength FROM ("
    + "\nUNION ALL\n".join(f"SELECT '{c}' AS feature, {_corr_expr(c, 'CAST(Chuva AS DOUBLE)')[0]} AS r FROM {labelled_sql()} l" for c in TARGET_FEATURES)
    + ") t",
)
def q_target_correlations(spark, sf):
    return profile.target_correlations(labelled(spark, sf), "Chuva", TARGET_FEATURES)


ROLE_KEYWORDS = ["TEMP", "HUMIDITY", "PRESSURE", "RAIN"]
_ROLE_CANDIDATES = {
    "TEMP": ["temp", "temp_max", "temp_min"],
    "HUMIDITY": ["humidity_max", "humidity_min", "humidity"],
    "PRESSURE": ["pressure_max", "pressure_min", "pressure"],
    "RAIN": ["rain_mm"],
}


def _best_role_sql():
    parts = []
    for k, cands in _ROLE_CANDIDATES.items():
        rows = " UNION ALL ".join(
            f"SELECT '{c}' AS col, {GAPPY_COLS.index(c)} AS pos, CAST(count({c}) AS BIGINT) AS n_valid FROM {gappy_sql()} g" for c in cands
        )
        parts.append(f"SELECT '{k}' AS keyword, col AS \"column\", n_valid FROM ({rows}) x ORDER BY n_valid DESC, pos LIMIT 1")
    return "\nUNION ALL\n".join(f"SELECT * FROM ({p}) s{i}" for i, p in enumerate(parts))


@query("best_column_by_role", _best_role_sql())
def q_best_column_by_role(spark, sf):
    """Per keyword, the matching column with the fewest missing values."""
    return profile.best_column_by_role(gappy(spark, sf), ROLE_KEYWORDS)


@query(
    "prediction_summary",
    f"""SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(y_pred) AS BIGINT) AS n_pred_events, {R('avg(CAST(y_pred AS DOUBLE)) * 100.0')} AS pct_pred_events,
       {R('avg(greatest(amount_pred - 50, 0.0))')} AS mean_mm, {R('max(greatest(amount_pred - 50, 0.0))')} AS max_mm FROM {scores_sql()} s""",
)
def q_prediction_summary(spark, sf):
    s = scores(spark, sf).select(F.col("y_pred").alias("previsao_chuva"), F.greatest(F.col("amount_pred") - 50, F.lit(0.0)).alias("quantidade_chuva_prevista_mm"))
    return profile.prediction_summary(s)


PCT_FEATURES = ["temp", "humidity", "pressure"]


@query(
    "train_percentile",
    "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS feature, {R('first(v)')} AS value, {R(f'100.0 * avg(CASE WHEN {c} <= v THEN 1.0 ELSE 0.0 END) FILTER (WHERE {c} IS NOT NULL)')} AS percentile,
       {R(f'avg({c})')} AS mean, {R(f'stddev_samp({c})')} AS std
FROM {obs_sql()} o, (SELECT avg({c}) + 1 AS v FROM {obs_sql()} o2) s"""
        for c in PCT_FEATURES
    ),
)
def q_train_percentile(spark, sf):
    """Percentile of a one-row scenario (each feature's mean + 1) among the training values."""
    o = obs(spark, sf)
    scenario = o.agg(*[(F.avg(c) + 1).alias(c) for c in PCT_FEATURES])
    return profile.train_percentile(o, PCT_FEATURES, scenario)


def _ranks_sql():
    """Training values and asked values in one order; the running sum counts the former."""
    parts = []
    for c in PCT_FEATURES:
        points = f"SELECT NULL AS event_id, {c} AS v, 1 AS n FROM {gappy_sql()} g WHERE {c} IS NOT NULL UNION ALL SELECT event_id, {c} + 0.37, 0 FROM {gappy_sql()} q"
        upto = f"SELECT event_id, v, CASE WHEN v IS NOT NULL THEN sum(n) OVER (ORDER BY v NULLS LAST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS upto FROM ({points}) p"
        stats = f"SELECT count({c}) AS total, avg({c}) AS m, stddev_samp({c}) AS s FROM {gappy_sql()} g"
        parts.append(
            f"SELECT event_id, '{c}' AS feature, {R('v')} AS value, {R('upto * 100.0 / total')} AS percentile, {R('m')} AS mean, {R('s')} AS std "
            f"FROM ({upto}) u, ({stats}) t WHERE event_id IS NOT NULL"
        )
    return "\nUNION ALL\n".join(parts)


@query("train_percentile_rows", _ranks_sql())
def q_train_percentile_rows(spark, sf):
    """Percentile of every row's (shifted) measures among the training values, gaps on both sides."""
    train = gappy(spark, sf)
    rows = train.select("event_id", *[(F.col(c) + F.lit(0.37)).alias(c) for c in PCT_FEATURES])
    return profile.train_percentiles(train, PCT_FEATURES, rows, ["event_id"])
