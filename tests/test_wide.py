"""Correlations of wide tables, splits without exchange, encoders that refuse unknown values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratus.operators import encode, profile, sampling


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def wide(spark, rows, columns):
    draw = np.random.default_rng(3)
    x = draw.normal(1000, 5, (rows, columns)) + draw.normal(0, 5, (rows, 1))
    x[draw.random((rows, columns)) < 0.2] = np.nan
    x[:, 5] = 7.0  # constant: no correlation
    if columns > 9:
        x[:, 9] = np.nan  # no value at all
    names = [f"c{i}" for i in range(columns)]
    data = [tuple(None if math.isnan(v) and i % 2 else float(v) for i, v in enumerate(r)) for r in x]
    return x, spark.createDataFrame(data, ", ".join(f"{n} double" for n in names)).repartition(3)


def test_62_columns_equal_pairwise_correlations(spark):
    x, df = wide(spark, 300, 62)
    got = {(r.col_a, r.col_b): (r.r, r.n_pairs) for r in profile.correlation_matrix(df).collect()}
    assert len(got) == 62 * 62
    for i in range(62):
        for j in range(62):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            r, n = got[f"c{i}", f"c{j}"]
            assert n == both.sum()
            if n == 0 or 5 in (i, j):
                assert r is None
            else:
                assert r == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-9)
    top = profile.top_correlations(df, n=5).collect()
    assert len(top) == 5 and top[0].abs_r >= top[4].abs_r


def test_blocks_equal_the_narrow_form(spark):
    _, df = wide(spark, 100, 11)
    rows = lambda m: sorted((r.col_a, r.col_b, r.n_pairs, None if r.r is None else round(r.r, 9)) for r in m.collect())
    for least in (1, 70):
        assert rows(profile._block_correlations(df, df.columns, least)) == rows(profile.correlation_matrix(df, min_periods=least))
    none = df.where("c0 < 0 and c0 > 0")
    assert rows(profile._block_correlations(none, df.columns, 1)) == rows(profile.correlation_matrix(none))


def test_wide_plan_does_not_grow_with_pairs(spark, tmp_path):
    sizes = []
    for columns in (16, 62):
        _, df = wide(spark, 20, columns)
        df.write.parquet(f"file://{tmp_path}/w{columns}")
        plan = plan_of(profile.correlation_matrix(spark.read.parquet(f"file://{tmp_path}/w{columns}")))
        assert plan.count("Scan parquet") == 1
        sizes.append(plan.count("covar_pop("))
    assert sizes[0] == sizes[1] > 0


def test_splits_without_exchange(spark):
    df = spark.range(40_000).select(F.col("id").alias("key"), F.when(F.col("id") % 10 == 0, None).otherwise(F.col("id") % 3).alias("label"))
    one = sampling.random_split(df, ["key"], 0.2, exact=False)
    by_class = sampling.stratified_split(df, ["key"], "label", 0.2, exact=False, fractions={1: 0.5, None: 0.05})
    for split in (one, by_class):
        assert "Exchange" not in plan_of(split) and split.columns == ["key", "label", "is_test"]

    def near(rows, n, fraction):
        assert abs(rows / n - fraction) <= 5 * math.sqrt(fraction * (1 - fraction) / n)

    near(one.where("is_test").count(), 40_000, 0.2)
    for label, fraction in ((0, 0.2), (1, 0.5), (2, 0.2), (None, 0.05)):
        rows = by_class.where(F.col("label").eqNullSafe(F.lit(label)))
        near(rows.where("is_test").count(), rows.count(), fraction)
    keys = {r.key for r in one.where("is_test").collect()}
    assert keys == {r.key for r in sampling.random_split(df.repartition(7), ["key"], 0.2, exact=False).where("is_test").collect()}
    # the same order as the exact split: its test rows are the lowest hashes too
    exact = {r.key for r in sampling.random_split(df, ["key"], 0.2).where("is_test").collect()}
    assert keys <= exact or exact <= keys
    assert sampling.random_split(df, ["key"], 1.0, exact=False).where("not is_test").count() == 0
    with pytest.raises(ValueError):
        sampling.stratified_split(df, ["key"], "label", fractions={1: 0.5})


def test_encoder_modes_for_unknown_values(spark):
    encoder = encode.label_encode_fit(spark.createDataFrame([("a", "x"), ("b", None)], "p string, q string"), ["p", "q"])
    rows = spark.createDataFrame([("b", "x"), ("a", None)], "p string, q string")
    for unknown in (-1, 99, "raise"):
        assert sorted(map(tuple, encode.label_encode_apply(rows, encoder, unknown=unknown).collect())) == [(0, 0), (1, 1)]
    new = rows.unionByName(spark.createDataFrame([("a", "zzz")], "p string, q string"))
    assert sorted(map(tuple, encode.label_encode_apply(new, encoder).collect())) == [(0, -1), (0, 0), (1, 1)]
    with pytest.raises(Exception, match="unknown value in column q: zzz"):
        encode.label_encode_apply(new, encoder, unknown="raise").collect()
    with pytest.raises(ValueError):
        encode.label_encode_apply(new, encoder, unknown="drop")


def test_percentiles_of_many_rows(spark):
    draw = np.random.default_rng(5)
    train = [None if i % 9 == 0 else (math.nan if i % 11 == 0 else 3.0 if i % 3 == 0 else float(draw.integers(0, 40))) for i in range(500)]
    asked = [None if i % 7 == 0 else (3.0 if i % 2 else float(draw.integers(-5, 50)) + 0.5) for i in range(300)]
    t = spark.createDataFrame([(v, None, i) for i, v in enumerate(train)], "x double, none double, extra int").repartition(4)
    rows = spark.createDataFrame([(i, v, 1.0) for i, v in enumerate(asked)] + [(0, 3.0, None)], "value int, x double, none double").repartition(3)
    out = profile.train_percentiles(t, ["x", "none"], rows.withColumnRenamed("value", "column"), ["column"])
    got = out.collect()
    known = np.array([v for v in train if v is not None and not math.isnan(v)])
    assert len(got) == 2 * 301
    for r in got:
        if r.feature == "none":
            assert r.percentile is None and r["mean"] is None
            continue
        assert r["mean"] == pytest.approx(known.mean()) and r["std"] == pytest.approx(known.std(ddof=1))
        assert r.percentile == (None if r.value is None else pytest.approx((known <= r.value).mean() * 100))
    text = plan_of(out)
    assert "NestedLoop" not in text and "Cartesian" not in text
    empty = profile.train_percentiles(t.limit(0), ["x"], rows, ["value"]).collect()
    assert len(empty) == 301 and all(r.percentile is None for r in empty)
    assert profile.train_percentiles(t, ["x"], rows.limit(0), ["value"]).count() == 0


@pytest.mark.parametrize("order", ["text", "number", "day"])
def test_contiguous_folds_of_a_busy_minute(spark, order):
    exprs = {"text": "concat('k', lpad(cast(p as string), 9, '0'))", "number": "cast(p as decimal(20, 3))", "day": "date_add(date'2024-01-01', cast(p as int))"}
    # half of all rows share one place in the order
    df = spark.range(0, 20_003, 1, 7).selectExpr("id", "case when id % 2 = 0 then 700 when id % 101 = 0 then null else id end as p").withColumn("o", F.expr(exprs[order]))
    got = sampling.kfold(df, 6, order=["o"]).withColumn("task", F.input_file_name()).cache()
    assert got.count() == 20_003 and got.select("id").distinct().count() == 20_003
    folds = [r["n"] for r in got.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).orderBy("fold").collect()]
    assert folds == [3334] * 5 + [3333]
    spans = got.groupBy("fold").agg(F.min("o").alias("lo"), F.max("o").alias("hi"), F.count_if(F.col("o").isNull()).alias("nulls")).orderBy("fold").collect()
    assert all(a.hi <= b.lo for a, b in zip(spans, spans[1:]) if a.hi is not None and b.lo is not None)
    assert [s.nulls > 0 for s in spans] == [False] * 5 + [True]
    tasks = sorted(r["n"] for r in got.groupBy("task").agg(F.count(F.lit(1)).alias("n")).collect())
    assert len(tasks) == 8 and tasks[-1] <= 2 * tasks[len(tasks) // 2]
    got.unpersist()


def test_contiguous_folds_of_small_tables(spark):
    rows = spark.createDataFrame([(1, "b"), (2, "a"), (3, None)], "id int, o string")
    assert [(r.id, r.fold) for r in sampling.kfold(rows, 5, order=["o"]).orderBy("fold").collect()] == [(2, 0), (1, 1), (3, 2)]
    assert sampling.kfold(rows.limit(0), 5, order=["o"]).collect() == []
    same = spark.createDataFrame([(7, "x")] * 9, "id int, o string")
    assert sorted(r.fold for r in sampling.kfold(same, 3, order=["o"]).collect()) == [0] * 3 + [1] * 3 + [2] * 3
