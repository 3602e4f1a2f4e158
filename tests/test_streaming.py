"""Stateless scoring over a file stream (availableNow trigger) equals batch scoring."""

import os

from pyspark.sql import functions as F

from stratus.plans import scoring, training
from stratus.session import scratch_path
from stratus.streaming import score_files_stream


def test_stream_scores_every_file_once(spark):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    data = ev.select(
        "event_id",
        (F.col("value") > 60).cast("int").alias("Chuva"),
        F.col("value").alias("signal"),
        (F.col("event_id") % 13).cast("double").alias("noise"),
        F.col("event_type"),
    )
    bundle, _ = training.train_models(data, ["event_id"], "Chuva", None, num_trees=5, max_depth=4, cv_folds=2)
    src = scratch_path(spark, "stream-src")
    data.where("event_id % 2 = 0").write.parquet(os.path.join(src, "a"))
    data.where("event_id % 2 = 1").write.mode("append").parquet(os.path.join(src, "a"))
    sink = scratch_path(spark, "stream-sink")
    q = score_files_stream(spark, bundle, os.path.join(src, "a"), data.schema, sink)
    q.awaitTermination(300)
    out = spark.read.parquet(sink)
    assert out.count() == data.count()
    batch = {r["event_id"]: r["previsao_chuva"] for r in scoring.score_batch(bundle, data).collect()}
    assert {r["event_id"]: r["previsao_chuva"] for r in out.collect()} == batch
