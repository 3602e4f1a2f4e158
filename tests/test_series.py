"""Bucketed per-station windows equal the plain per-station window (brute force), whatever the bucket width."""

import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as E
from stratus.operators import features as FE
from stratus.operators import fill as FL
from stratus.operators import sampling
from stratus.operators import series as S
from tests.work import work

KEY = ["user_id"]
ORDER = ["ts", "event_id"]


def gappy(events):
    # long gaps and short gaps, deterministic
    v = F.when((F.col("event_id") % 7).isin(0, 1) | ((F.col("event_id") % 400) < 60), None).otherwise(F.col("value"))
    return events.select("event_id", "ts", "user_id", v.alias("value"))


def close(a, b):
    if a is None or b is None:
        return a is None and b is None
    return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)


def compare(df_a, df_b, cols):
    a = {r["event_id"]: r for r in df_a.collect()}
    b = {r["event_id"]: r for r in df_b.collect()}
    assert a.keys() == b.keys()
    bad = [(k, c, a[k][c], b[k][c]) for k in a for c in cols if not close(a[k][c], b[k][c])]
    assert not bad, bad[:5]


#: seconds of a bucket: most hold no or one row of a station, a few rows, many, all
WIDTHS = [600, 7200, 86_400, S.DEFAULT_BUCKET_SECONDS]


@pytest.mark.parametrize("width", WIDTHS)
def test_sequence_matches_row_number(events, width):
    seqd = S.sequence(events, KEY, ORDER, bucket=S.time_bucket("ts", width))
    ref = events.withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    got = {r["event_id"]: r[S.SEQ] for r in seqd.select("event_id", S.SEQ).collect()}
    exp = {r["event_id"]: r["rn"] for r in ref.select("event_id", "rn").collect()}
    assert got == exp


@pytest.mark.parametrize("width", WIDTHS)
def test_lag_rolling_match(events, width):
    df = gappy(events)
    got = FE.lag_and_rolling(df, ["value"], [1, 3, 6], ["value"], [3, 6, 12], key=KEY, order=ORDER, bucket=S.time_bucket("ts", width))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    exp = df.withColumns(
        {
            **{f"value_lag_{n}h": F.lag("value", n).over(w) for n in [1, 3, 6]},
            **{f"value_rolling_mean_{n}h": F.avg("value").over(w.rowsBetween(-(n - 1), 0)) for n in [3, 6, 12]},
            **{f"value_rolling_std_{n}h": F.stddev_samp("value").over(w.rowsBetween(-(n - 1), 0)) for n in [3, 6, 12]},
        }
    )
    cols = [c for c in exp.columns if "_lag_" in c or "_rolling_" in c]
    assert got.count() == df.count()
    compare(got, exp, cols)


def brute_interpolate(values, limit):
    """pandas-style linear interpolation, limit on both sides of each gap."""
    n = len(values)
    out = list(values)
    valid = [i for i, v in enumerate(values) if v is not None]
    for i, v in enumerate(values):
        if v is not None:
            continue
        prev = max((j for j in valid if j < i), default=None)
        nxt = min((j for j in valid if j > i), default=None)
        near_p = prev is not None and (limit is None or i - prev <= limit)
        near_n = nxt is not None and (limit is None or nxt - i <= limit)
        if prev is not None and nxt is not None and (near_p or near_n):
            out[i] = values[prev] + (values[nxt] - values[prev]) * (i - prev) / (nxt - prev)
        elif prev is not None and nxt is None and near_p:
            out[i] = values[prev]
        elif prev is None and nxt is not None and near_n:
            out[i] = values[nxt]
    return out


@pytest.mark.parametrize("width,limit", [(600, 3), (7200, None), (86_400, 3), (S.DEFAULT_BUCKET_SECONDS, None)])
def test_interpolate_matches_brute(events, width, limit):
    df = gappy(events)
    got = FL.fill_interpolate(df, ["value"], key=KEY, order=ORDER, limit=limit, bucket=S.time_bucket("ts", width))
    rows = df.orderBy("user_id", "ts", "event_id").collect()
    exp = {}
    by_user = {}
    for r in rows:
        by_user.setdefault(r["user_id"], []).append(r)
    for rs in by_user.values():
        filled = brute_interpolate([r["value"] for r in rs], limit)
        exp.update({r["event_id"]: f for r, f in zip(rs, filled)})
    g = {r["event_id"]: r["value"] for r in got.collect()}
    assert g.keys() == exp.keys()
    bad = [(k, g[k], exp[k]) for k in g if not close(g[k], exp[k])]
    assert not bad, bad[:5]


@pytest.mark.parametrize("width", WIDTHS)
def test_ffill_bfill_match(events, width):
    df = gappy(events)
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    f = FL.fill_forward(df, ["value"], key=KEY, order=ORDER, limit=3, bucket=S.time_bucket("ts", width))
    fe = df.withColumn("value", F.last("value", True).over(w.rowsBetween(-3, 0)))
    compare(f, fe, ["value"])
    b = FL.fill_backward(df, ["value"], key=KEY, order=ORDER, limit=3, bucket=S.time_bucket("ts", width))
    be = df.withColumn("value", F.first("value", True).over(w.rowsBetween(0, 3)))
    compare(b, be, ["value"])


def test_null_station_is_its_own_series(spark):
    import datetime as dt

    rows = [(None if i % 2 else 1, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), i, float(i)) for i in range(10)]
    df = spark.createDataFrame(rows, "station_id long, ts timestamp_ntz, rid long, v double")
    out = FE.lag_features(df, ["v"], [1], key=["station_id"], order=["ts"], bucket=S.time_bucket("ts", 7200))
    got = {r["rid"]: r["v_lag_1h"] for r in out.collect()}
    # even rows belong to station 1, odd rows to the NULL station; each lags within its own series
    assert got == {0: None, 2: 0.0, 4: 2.0, 6: 4.0, 8: 6.0, 1: None, 3: 1.0, 5: 3.0, 7: 5.0, 9: 7.0}


def hourly(spark, path, stations=3, hours=400):
    import datetime as dt

    rows = [(s, dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), s * 1000 + h, None if h % 5 == 0 else float(h * s), f"x{h}") for s in range(stations) for h in range(hours)]
    spark.createDataFrame(rows, "station_id long, ts timestamp_ntz, rid long, v double, other string").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("rows", [1, 3, 24, 240])
def test_hourly_lag_24_for_any_rows_per_bucket(spark, tmp_path, rows):
    df = hourly(spark, f"file://{tmp_path}/hourly")
    bucket = S.time_bucket("ts", 3600 * rows)
    got = {r["rid"]: r for r in FE.lag_and_rolling(df, ["v"], [1, 24], ["v"], [24], bucket=bucket).collect()}
    back = {r["rid"]: r["v"] for r in FL.fill_backward(df, ["v"], bucket=bucket, limit=3).collect()}
    value = {r["rid"]: r["v"] for r in df.collect()}
    assert set(got) == set(back) == set(value)
    for rid, r in got.items():
        start = rid // 1000 * 1000
        assert r["v_lag_1h"] == value.get(rid - 1) and r["v_lag_24h"] == (value[rid - 24] if rid - 24 >= start else None)
        seen = [value[k] for k in range(max(start, rid - 23), rid + 1) if value[k] is not None]
        assert close(r["v_rolling_mean_24h"], sum(seen) / len(seen) if seen else None)
        assert back[rid] == next((value[k] for k in range(rid, rid + 4) if value.get(k) is not None), None)


def test_rows_without_a_time_come_last_in_an_order_of_their_own(spark):
    import datetime as dt

    rows = [(1, None if i >= 5 else dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), i) for i in range(60)]
    df = spark.createDataFrame(rows, "station_id long, ts timestamp_ntz, rid long")
    seq = {r["rid"]: r[S.SEQ] for r in S.sequence(df, ["station_id"], ["ts", "rid"]).collect()}
    assert [seq[i] for i in range(5)] == [1, 2, 3, 4, 5] and sorted(seq.values()) == list(range(1, 61))


OPERATORS = {
    "lag": lambda df: FE.lag_features(df, ["v"], [1, 24]),
    "rolling": lambda df: FE.rolling_features(df, ["v"], [12]),
    "forward": lambda df: FL.fill_forward(df, ["v"]),
    "backward": lambda df: FL.fill_backward(df, ["v"]),
    "interpolate": lambda df: FL.fill_interpolate(df, ["v"]),
    "sequence": lambda df: S.sequence(df, ["station_id"], ["ts"]),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_scan_and_one_shuffle_of_the_rows(spark, tmp_path, name):
    df = hourly(spark, f"file://{tmp_path}/hourly", 10, 2000)
    n = df.count()
    for out in (OPERATORS[name](df), OPERATORS[name](df).drop("other", "station_id")):
        read, shuffled = work(out)
        assert read == n and shuffled <= 1.5 * n


@pytest.mark.parametrize("name", ["lag_features", "rolling_mean", "rolling_std", "fill_forward", "fill_backward", "fill_interpolate", "kfold"])
def test_queries_read_once(spark, name):
    sf = "/root/testdata/sf0.1"
    n = spark.read.parquet(f"{sf}/events.parquet").count()
    read, shuffled = work(E.queries()[name](spark, sf))
    assert read == n and shuffled <= 1.5 * n


def test_splits_read_the_rows_once(spark):
    ev = spark.read.parquet("/root/testdata/sf0.1/events.parquet")
    n = ev.count()
    read, shuffled = work(sampling.random_split(ev, ["event_id"]))
    assert read == n and shuffled <= 1.5 * n
    read, shuffled = work(sampling.stratified_split(ev.withColumn("y", (F.col("value") > 60).cast("int")), ["event_id"], "y"))
    assert read == n and shuffled <= 1.5 * n


@pytest.mark.parametrize("rows", [7, 100, 1500])
def test_frames_of_720_rows(spark, rows):
    df = spark.range(0, 4000, 1, 5).selectExpr(
        "id % 2 AS station_id", "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, int(id div 2)) AS ts", "id AS rid", "CASE WHEN id % 5 > 0 THEN sin(id) * 100 END AS v"
    )
    got = {r["rid"]: r for r in FE.rolling_features(df, ["v"], [720], bucket=S.time_bucket("ts", 3600 * rows)).collect()}
    assert len(got) == 4000
    for station in (0, 1):
        v = np.array([got[k]["v"] for k in range(station, 4000, 2)], dtype=float)
        for i in range(2000):
            seen = v[max(0, i - 719) : i + 1]
            seen = seen[~np.isnan(seen)]
            r = got[2 * i + station]
            assert close(r["v_rolling_mean_720h"], seen.mean() if len(seen) else None)
            assert close(r["v_rolling_std_720h"], seen.std(ddof=1) if len(seen) > 1 else None)


@pytest.mark.parametrize("rows", [1, 50, 1000])
def test_carried_rows_are_linear_in_the_frame(spark, rows):
    df = spark.range(5000).selectExpr("1 AS station_id", "id AS o")
    kcols, ranked = S.bucket_ranks(df, ["station_id"], ["o"], F.floor(F.col("o") / rows))
    held = F.struct(F.col(S.RANK).cast("long").alias("r"))
    offsets = S.bucket_offsets(S.bucket_summary(ranked, kcols, F.sort_array(F.collect_list(held)).alias("all")), kcols)
    for carry, pick in ((S.rows_before, "slice(all, -least(720, size(all)), 720)"), (S.rows_after, "slice(all, 1, 720)")):
        placed, near = carry(offsets.withColumn("ends", F.expr(pick)), kcols, "ends", 720)
        got = placed.select("__o", "__n", near.alias("near")).collect()
        for r in got:
            met = [t.r for t in r.near]
            wanted = range(max(1, r["__o"] - 719), r["__o"] + 1) if carry is S.rows_before else range(r["__o"] + r["__n"] + 1, min(5000, r["__o"] + r["__n"] + 720) + 1)
            assert len(met) <= 1440 and met == sorted(met) and set(wanted) <= set(met)


def test_buckets_fit_the_densest_station(spark, monkeypatch):
    rows = "SELECT id % 3 AS station_id, timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, id * 60) AS ts, id FROM range(3000)"
    df = spark.sql(rows + " UNION ALL SELECT 1, NULL, -id FROM range(5000)")
    fullest = lambda bucket: df.where("ts is not null").groupBy("station_id", bucket.alias("b")).count().agg(F.max("count")).first()[0]
    monkeypatch.setattr(S, "TASK_ROWS", 100)
    bucket, parts = S.dense_bucket(df, ["station_id"], "ts", rows=50)
    assert fullest(S.default_bucket(df, ["ts"])) == 1000 and 10 < fullest(bucket) <= 50 and parts == 80
    monkeypatch.setattr(S, "TASK_ROWS", 8000)
    bucket, parts = S.dense_bucket(df, ["station_id"], "ts", rows=1000)
    assert fullest(bucket) == 1000 and parts is None  # sparse enough as it is


def test_more_partitions_give_the_same_rows(spark):
    df = spark.sql("SELECT id % 3 AS station_id, timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, id * 60) AS ts, IF(id % 7 < 2, NULL, id * 1.5D) AS v, id FROM range(600)")
    bucket = S.time_bucket("ts", 3600)

    def run(parts):
        out = FL.fill_interpolate(df, ["v"], order=["ts", "id"], bucket=bucket, parts=parts)
        return FE.lag_and_rolling(out, ["v"], [1, 3], ["v"], [6], order=["ts", "id"], bucket=bucket, parts=parts)

    many = run(19)
    assert sorted(many.collect()) == sorted(run(None).collect())
    assert "REPARTITION_BY_NUM" in many._jdf.queryExecution().executedPlan().toString()
