"""Per-station lag / rolling windows and ROC points."""

from __future__ import annotations

from stratus.bindings import R, query
from stratus.bindings.fixtures import gappy, gappy_sql, obs, obs_sql, scores, scores_sql
from stratus.operators import features, metrics

KEY = ["station_id"]
ORDER = ["ts", "event_id"]
PART = "PARTITION BY station_id ORDER BY ts, event_id"
LAG_COLS = ["temp", "humidity", "pressure"]
LAGS = [1, 3, 6]
ROLL_COLS = ["temp", "humidity"]
WINDOWS = [3, 6, 12]


@query(
    "lag_features",
    "SELECT event_id, " + ", ".join(f"{R(f'lag({c}, {n}) OVER ({PART})')} AS {c}_lag_{n}h" for c in LAG_COLS for n in LAGS) + f" FROM {obs_sql()} o",
)
def q_lag_features(spark, sf):
    """Values 1, 3 and 6 rows earlier in each station's time order."""
    o = obs(spark, sf).select("event_id", "station_id", "ts", *LAG_COLS)
    out = features.lag_features(o, LAG_COLS, LAGS, key=KEY, order=ORDER)
    return out.select("event_id", *[f"{c}_lag_{n}h" for c in LAG_COLS for n in LAGS])


def _roll_sql(fn, stat):
    return (
        "SELECT event_id, "
        + ", ".join(f"{R(f'{fn}({c}) OVER ({PART} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)')} AS {c}_rolling_{stat}_{n}h" for c in ROLL_COLS for n in WINDOWS)
        + f" FROM {gappy_sql()} g"
    )


@query("rolling_mean", _roll_sql("avg", "mean"))
def q_rolling_mean(spark, sf):
    """Trailing 3/6/12-row means (≥ 1 value) over gappy measures."""
    g = gappy(spark, sf).select("event_id", "station_id", "ts", *ROLL_COLS)
    out = features.rolling_features(g, ROLL_COLS, WINDOWS, key=KEY, order=ORDER, stats=("mean",))
    return out.select("event_id", *[f"{c}_rolling_mean_{n}h" for c in ROLL_COLS for n in WINDOWS])


@query("rolling_std", _roll_sql("stddev_samp", "std"))
def q_rolling_std(spark, sf):
    """Trailing 3/6/12-row sample std (NULL below 2 values)."""
    g = gappy(spark, sf).select("event_id", "station_id", "ts", *ROLL_COLS)
    out = features.rolling_features(g, ROLL_COLS, WINDOWS, key=KEY, order=ORDER, stats=("std",))
    return out.select("event_id", *[f"{c}_rolling_std_{n}h" for c in ROLL_COLS for n in WINDOWS])


@query(
    "roc_curve",
    f"""WITH per AS (SELECT prob AS s, count(*) FILTER (WHERE y_true = 1) AS pos, count(*) FILTER (WHERE y_true <> 1) AS neg FROM {scores_sql()} x GROUP BY prob),
cum AS (SELECT s, sum(pos) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS tp, sum(neg) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS fp FROM per),
tot AS (SELECT sum(pos) AS p, sum(neg) AS n FROM per)
SELECT CAST('inf' AS DOUBLE) AS threshold, {R('0.0')} AS fpr, {R('0.0')} AS tpr
UNION ALL
SELECT {R('s')} AS threshold, {R('fp / n')} AS fpr, {R('tp / p')} AS tpr FROM cum, tot""",
)
def q_roc_curve(spark, sf):
    return metrics.roc_curve(scores(spark, sf), "y_true", "prob")
