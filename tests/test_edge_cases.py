"""Hand-made micro-frames for the edge cases listed in FIXTURES.md."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from stratus.functions.calendar import build_timestamp, day_period, season
from stratus.functions.numeric import parse_number, rain_flag
from stratus.operators import clean, encode, features, fill, metrics, profile, sampling
from stratus.operators.ranges import quantiles, value_table
from stratus.operators.series import time_bucket
from stratus.session import clear_scratch, scratch_path, wide_plans
from tests.work import work

T0 = dt.datetime(2024, 1, 1)


def series(spark, values, station=1):
    rows = [(station, T0 + dt.timedelta(hours=i), i, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "station_id long, ts timestamp_ntz, rid long, v double")


def filled(spark, values, limit=3, hours=240):
    out = fill.fill_interpolate(series(spark, values), ["v"], limit=limit, bucket=time_bucket("ts", 3600 * hours))
    return [r["v"] for r in out.orderBy("rid").collect()]


@pytest.mark.parametrize("gap,left", [(1, 0), (3, 0), (6, 0), (7, 1), (8, 2)])
def test_interpolation_gap_lengths(spark, gap, left):
    vals = [0.0] + [None] * gap + [float(gap + 1)]
    got = filled(spark, vals)
    assert sum(v is None for v in got) == left
    for i, v in enumerate(got):
        if v is not None:
            assert math.isclose(v, float(i))


def test_interpolation_leading_trailing(spark):
    got = filled(spark, [None] * 5 + [10.0, 20.0] + [None] * 5)
    assert got[:2] == [None, None] and got[2:5] == [10.0] * 3
    assert got[7:10] == [20.0] * 3 and got[10:] == [None, None]


def test_interpolation_over_buckets_equals_whole(spark):
    vals = [None, 1.0, None, None, None, None, None, None, None, 9.0, None, 11.0, None, None]
    assert filled(spark, vals, hours=2) == filled(spark, vals, hours=1) == filled(spark, vals)


def test_one_row_window(spark):
    df = series(spark, [5.0])
    out = features.rolling_features(df, ["v"], [3]).first()
    assert out["v_rolling_mean_3h"] == 5.0 and out["v_rolling_std_3h"] is None


def test_constant_column(spark):
    df = spark.createDataFrame([(float(i), 1.0) for i in range(20)], "a double, b double")
    r = profile.correlation_matrix(df, ["a", "b"]).where("col_a = 'a' AND col_b = 'b'").first()["r"]
    assert r is None
    kept = clean.drop_outliers_sigma(df, ["b"]).where(F.col("b").isNull()).count()
    assert kept == 0


def test_parse_number(spark):
    df = spark.createDataFrame([("NaN",), ("inf",), ("nan",), ("",), (" 1,5 ",), ("n/d",), ("0000 UTC",)], "s string")
    got = [r[0] for r in df.select(parse_number("s")).collect()]
    assert got == [None, None, None, None, 1.5, None, None]


def test_rain_flag(spark):
    df = spark.createDataFrame([(None,), (0.0,), (0.2,)], "r double")
    assert [r[0] for r in df.select(rain_flag("r")).collect()] == [0, 0, 1]


def test_missing_hour_and_month(spark):
    df = spark.createDataFrame([(None, None)], "h int, m int")
    r = df.select(day_period(F.col("h")), season(F.col("m"))).first()
    assert tuple(r) == ("madrugada", "primavera")


def test_unknown_category(spark):
    fit = spark.createDataFrame([("a",), ("b",), (None,)], "c string")
    enc = encode.label_encode_fit(fit, ["c"])
    codes = {r["value"]: r["code"] for r in enc.collect()}
    assert codes == {"a": 0, "b": 1, "nan": 2}
    new = spark.createDataFrame([("b",), ("zzz",), (None,)], "c string")
    assert [r[0] for r in encode.label_encode_apply(new, enc, ["c"]).collect()] == [1, -1, 2]


def test_all_predictions_zero(spark):
    df = spark.createDataFrame([(1, 0), (0, 0), (1, 0)], "y_true int, y_pred int")
    r = metrics.classification_metrics(df).first()
    assert r["precision"] == 0.0 and r["f1"] == 0.0 and math.isclose(r["accuracy"], 1 / 3)


def test_histogram_max_in_last_bin(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)], "x double")
    h = {r["bin"]: r["count"] for r in profile.histogram(df, "x", 5).collect()}
    assert h == {0: 2, 1: 2, 2: 2, 3: 2, 4: 3}


def test_iso_week_year_end(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 12, 30),)], "d timestamp_ntz")
    r = features.time_parts(df, "d").first()
    assert r["semana_ano"] == 1 and r["dia_semana"] == 0


def test_build_timestamp_forms(spark):
    df = spark.createDataFrame([("2024/01/02", "0100"), ("2024/01/02", "100"), ("2024/01/02", "0100 UTC"), ("2024/01/02", "xx"), ("bad", "0100")], "d string, h string")
    got = [r[0] for r in df.select(build_timestamp(F.col("d"), F.col("h"))).collect()]
    assert got[:3] == [dt.datetime(2024, 1, 2, 1, 0)] * 3 and got[3:] == [None, None]


def test_stratified_split_sizes(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 10 == 0).cast("int").alias("y"))
    from stratus.operators.sampling import stratified_split

    s = stratified_split(df, ["id"], "y", 0.2, bits=4)
    got = {(r["y"], r["is_test"]): r["count"] for r in s.groupBy("y", "is_test").count().collect()}
    assert got == {(0, True): 180, (0, False): 720, (1, True): 20, (1, False): 80}


# --- NULL classes are classes


def with_null_label(spark):
    rows = [(i, None if i % 10 == 0 else i % 2, float(i)) for i in range(100)]
    return spark.createDataFrame(rows, "id long, y int, x double")


def test_null_label_rows_are_split(spark):
    out = sampling.stratified_split(with_null_label(spark), ["id"], "y", 0.2).collect()
    assert len(out) == 100 and sum(r["is_test"] for r in out if r["y"] is None) == 2
    folds = sampling.kfold(with_null_label(spark), 5, key=["id"], label="y").collect()
    assert len(folds) == 100 and sorted(r["fold"] for r in folds if r["y"] is None) == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4]


def test_null_label_rows_are_counted(spark):
    df = with_null_label(spark)
    hist = profile.histogram(df, "x", 5, by="y").collect()
    assert sum(r["count"] for r in hist) == 100 and sum(r["count"] for r in hist if r["y"] is None) == 10
    box = {r["y"]: r for r in profile.box_stats(df, "x", by="y").collect()}
    assert box[None]["n"] == 10 and box[None]["median"] == 45.0 and box[None]["whisker_high"] == 90.0
    assert encode.with_class_weight(df, "y").where("weight is null").count() == 0


def test_quantiles_equal_pandas(spark):
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(3)
    a = np.where(rng.random(3000) < 0.4, 7.0, np.round(rng.normal(size=3000), 2))
    b = np.where(rng.random(3000) < 0.1, np.nan, rng.normal(size=3000))
    frame = pd.DataFrame({"a": a, "b": b, "none": [None] * 3000, "g": rng.integers(0, 3, 3000)}).astype({"none": "float64"})
    df = spark.createDataFrame(frame)
    found = {r["column"]: r for r in quantiles(value_table(df, ["a", "b", "none"]), [0, 0.25, 0.5, 0.9, 1]).collect()}
    for c in ("a", "b"):
        want = frame[c].quantile([0, 0.25, 0.5, 0.9, 1]).tolist()
        assert all(math.isclose(found[c][f"q{i}"], w, abs_tol=1e-12) for i, w in enumerate(want))
    assert found["none"]["count"] == 0 and found["none"]["q2"] is None
    by = {r["g"]: r["q0"] for r in quantiles(value_table(df, ["a"], ["g"]), [0.5], ["g"]).collect()}
    assert by == frame.groupby("g").a.median().to_dict()


def test_quantiles_of_no_rows(spark):
    empty = spark.createDataFrame([], "a double")
    assert quantiles(value_table(empty, ["a"]), [0.5]).count() == 0
    assert fill.fill_median_or_zero(empty, ["a"]).count() == 0


def test_no_percentile_over_a_column():
    import pathlib

    for path in pathlib.Path(profile.__file__).parents[1].rglob("*.py"):
        text = path.read_text()
        assert "F.percentile(" not in text and "F.median(" not in text, path


def test_profile_reads_do_not_grow_with_columns(spark):
    path = scratch_path(spark, "profile")
    spark.range(500).selectExpr(*[f"id * {i} % 97 AS c{i}" for i in range(12)]).write.parquet(path)
    df = spark.read.parquet(path)
    for columns in (["c1"], [f"c{i}" for i in range(12)]):
        out = profile.profile_columns(df, columns, samples=3)
        assert work(out)[0] <= 2 * 500  # the smallest values took three aggregates before
        assert out.count() == len(columns)
    assert len(str(profile.distinct_samples(df.selectExpr("cast(c1 as string) a", "cast(c2 as string) b"), n=5)._jdf.queryExecution().optimizedPlan())) < 3000


# --- session hygiene


def test_constraint_propagation_is_restored(spark):
    conf = "spark.sql.constraintPropagation.enabled"
    before = spark.conf.get(conf)
    with wide_plans(spark):
        assert spark.conf.get(conf) == "false"
    assert spark.conf.get(conf) == before


def test_scratch_is_removed_by_its_owner(spark, monkeypatch):
    from stratus import session

    monkeypatch.setattr(session, "_SCRATCH", [])
    path = scratch_path(spark, "mine")
    spark.range(3).write.parquet(path)
    assert clear_scratch(spark) == 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
