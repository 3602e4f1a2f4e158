"""Lookup joins carry no hint and keep NULL keys."""

from pyspark.sql import functions as F

from stratus.operators.joins import join_lookup


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_spark_chooses_the_join_by_size(spark):
    big = spark.range(1000).withColumn("k", F.col("id") % 3)
    small = spark.range(3).withColumnRenamed("id", "k").withColumn("w", F.col("k") * 2)
    assert "BroadcastHashJoin" in _plan(join_lookup(big, small, ["k"]))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = join_lookup(big, small, ["k"])
        assert out.count() == 1000 and "BroadcastHashJoin" not in _plan(out)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_null_keys_meet(spark):
    rows = spark.createDataFrame([(1,), (None,), (3,)], "k int")
    lookup = spark.createDataFrame([(1, "a"), (None, "b")], "k int, w string")
    assert {(r.k, r.w) for r in join_lookup(rows, lookup, ["k"]).collect()} == {(1, "a"), (None, "b"), (3, None)}
    assert {(r.k, r.w) for r in join_lookup(rows, lookup, ["k"], "inner").collect()} == {(1, "a"), (None, "b")}
