"""Gap-filling operators on the gappy observation series (station = user_id)."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratus.bindings import R, query
from stratus.bindings.fixtures import gappy, gappy_sql
from stratus.operators import fill

KEY = ["station_id"]
ORDER = ["ts", "event_id"]
COLS = ["temp", "humidity"]
PART = "PARTITION BY station_id ORDER BY ts, event_id"


def _interp_sql(cols, limit):
    sel = ["event_id"]
    wins = []
    for i, c in enumerate(cols):
        wins.append(
            f"""last_value(CASE WHEN {c} IS NOT NULL THEN rn END IGNORE NULLS) OVER w1 AS prn{i}, last_value({c} IGNORE NULLS) OVER w1 AS pv{i},
       first_value(CASE WHEN {c} IS NOT NULL THEN rn END IGNORE NULLS) OVER w2 AS nrn{i}, first_value({c} IGNORE NULLS) OVER w2 AS nv{i}"""
        )
        lp = f"rn - prn{i} <= {limit}" if limit is not None else "TRUE"
        ln = f"nrn{i} - rn <= {limit}" if limit is not None else "TRUE"
        expr = f"""CASE WHEN {c} IS NOT NULL THEN {c}
            WHEN prn{i} IS NOT NULL AND nrn{i} IS NOT NULL AND ({lp} OR {ln}) THEN pv{i} + (nv{i} - pv{i}) * (rn - prn{i}) / (nrn{i} - prn{i})
            WHEN prn{i} IS NOT NULL AND nrn{i} IS NULL AND {lp} THEN pv{i}
            WHEN prn{i} IS NULL AND nrn{i} IS NOT NULL AND {ln} THEN nv{i} END"""
        sel.append(f"{R(expr)} AS {c}")
    return f"""WITH s AS (SELECT event_id, station_id, {', '.join(cols)}, row_number() OVER ({PART}) AS rn FROM {gappy_sql()} g),
p AS (SELECT *, {', '.join(wins)} FROM s
      WINDOW w1 AS (PARTITION BY station_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
             w2 AS (PARTITION BY station_id ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT {', '.join(sel)} FROM p"""


def _src(spark, sf):
    return gappy(spark, sf).select("event_id", "station_id", "ts", *COLS)


def _out(df):
    return df.select("event_id", *COLS)


@query("fill_interpolate", _interp_sql(COLS, 3))
def q_fill_interpolate(spark, sf):
    """Linear interpolation by row position, at most 3 rows from either side of a gap."""
    return _out(fill.fill_interpolate(_src(spark, sf), COLS, key=KEY, order=ORDER, limit=3))


@query("fill_interpolate_unlimited", _interp_sql(COLS, None))
def q_fill_interpolate_unlimited(spark, sf):
    return _out(fill.fill_interpolate(_src(spark, sf), COLS, key=KEY, order=ORDER, limit=None))


@query(
    "fill_forward",
    "SELECT event_id, "
    + ", ".join(f"{R(f'last_value({c} IGNORE NULLS) OVER ({PART} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)')} AS {c}" for c in COLS)
    + f" FROM {gappy_sql()} g",
)
def q_fill_forward(spark, sf):
    return _out(fill.fill_forward(_src(spark, sf), COLS, key=KEY, order=ORDER, limit=3))


@query(
    "fill_backward",
    "SELECT event_id, "
    + ", ".join(f"{R(f'first_value({c} IGNORE NULLS) OVER ({PART} ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)')} AS {c}" for c in COLS)
    + f" FROM {gappy_sql()} g",
)
def q_fill_backward(spark, sf):
    return _out(fill.fill_backward(_src(spark, sf), COLS, key=KEY, order=ORDER, limit=3))


@query("fill_mean", "SELECT event_id, " + ", ".join(f"{R(f'coalesce({c}, avg({c}) OVER ())')} AS {c}" for c in COLS) + f" FROM {gappy_sql()} g")
def q_fill_mean(spark, sf):
    return fill.fill_mean(gappy(spark, sf).select("event_id", *COLS), COLS)


@query(
    "fill_median",
    "SELECT event_id, " + ", ".join(f"{R(f'coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM {gappy_sql()} g2))')} AS {c}" for c in COLS) + f" FROM {gappy_sql()} g",
)
def q_fill_median(spark, sf):
    return fill.fill_median(gappy(spark, sf).select("event_id", *COLS), COLS)


EMPTY = "CASE WHEN event_id < 0 THEN temp END"


@query(
    "fill_median_or_zero",
    "SELECT event_id, "
    + ", ".join(f"{R(f'coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM {gappy_sql()} g2), 0.0)')} AS {c}" for c in COLS)
    + f", {R('coalesce(empty, 0.0)')} AS empty FROM (SELECT *, {EMPTY} AS empty FROM {gappy_sql()} g0) g",
)
def q_fill_median_or_zero(spark, sf):
    """Training fill: median, and 0 for a column without any value."""
    df = gappy(spark, sf).select("event_id", *COLS, F.expr(EMPTY).alias("empty"))
    return fill.fill_median_or_zero(df, [*COLS, "empty"])


@query("fill_drop", "SELECT event_id, " + ", ".join(f"{R(c)} AS {c}" for c in COLS) + f" FROM {gappy_sql()} g WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in COLS))
def q_fill_drop(spark, sf):
    return fill.fill_drop(gappy(spark, sf).select("event_id", *COLS), COLS)
