"""Forest property checks: probabilities, clamping, separability, save/load parity."""

import math

import pytest
from pyspark.sql import functions as F

from stratus.operators import metrics
from stratus.plans import scoring, training
from stratus.session import scratch_path
from stratus.sources import models as persist


@pytest.fixture(scope="module")
def data(spark):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    return ev.select(
        "event_id",
        (F.col("value") > 60).cast("int").alias("Chuva"),
        F.when(F.col("value") > 60, (F.col("value") - 60) / 10).otherwise(0.0).alias("rain_mm"),
        (F.col("value") + (F.col("event_id") % 7)).alias("signal"),
        (F.col("event_id") % 13).cast("double").alias("noise"),
        F.col("event_type"),
    )


@pytest.fixture(scope="module")
def bundle(data):
    b, report = training.train_models(data, ["event_id"], "Chuva", "rain_mm", num_trees=10, max_depth=5)
    return b, report


def test_probabilities_and_clamp(bundle, data):
    b, _ = bundle
    s = scoring.score_batch(b, data)
    bad = s.where((F.col("prob_chuva") < 0) | (F.col("prob_chuva") > 1) | (F.col("quantidade_chuva_prevista_mm") < 0)).count()
    assert bad == 0
    assert s.count() == data.count()


def test_separable_auc(bundle, data):
    b, _ = bundle
    s = scoring.score_batch(b, data)
    auc = metrics.roc_auc(s, "Chuva", "prob_chuva").first()["auc"]
    assert auc > 0.9


def test_report_has_cv(bundle):
    _, report = bundle
    names = {r["metric"] for r in report.collect()}
    assert {"accuracy", "f1", "cv_f1_mean", "cv_f1_std", "rmse", "r2"} <= names


def test_save_load_same_scores(spark, bundle, data):
    b, _ = bundle
    path = scratch_path(spark, "test-bundle")
    persist.save_bundle(b, path)
    again = persist.load_bundle(spark, path)
    a1 = {r["event_id"]: r["prob_chuva"] for r in scoring.score_batch(b, data).collect()}
    a2 = {r["event_id"]: r["prob_chuva"] for r in scoring.score_batch(again, data).collect()}
    assert a1.keys() == a2.keys() and all(math.isclose(a1[k], a2[k]) for k in a1)
    assert again.features == b.features


def test_unknown_category_scores(spark, bundle, data):
    b, _ = bundle
    odd = data.withColumn("event_type", F.lit("never-seen"))
    assert scoring.score_batch(b, odd).where(F.col("previsao_chuva").isNull()).count() == 0


def test_medians_come_from_training_rows(data):
    odd = data.withColumn("signal", F.when(F.col("event_id") % 3 == 0, None).otherwise(F.col("signal")))
    fair = training.prepare_training(odd, "Chuva", "rain_mm", key=["event_id"])
    legacy = training.prepare_training(odd, "Chuva", "rain_mm", key=["event_id"], legacy=True)
    train = fair.data.where("not is_test").join(odd.select("event_id", F.col("signal").alias("own")), "event_id").where("own is not null")
    everything = odd.where("signal is not null")
    for rows, column, prep in ((train, "own", fair), (everything, "signal", legacy)):
        assert math.isclose(rows.agg(F.expr(f"percentile({column}, 0.5)")).first()[0], prep.medians["signal"])
    assert fair.medians["signal"] != legacy.medians["signal"]


def test_held_out_rows_are_those_of_the_split(spark, bundle, data):
    b, report = bundle
    held = {r["event_id"] for r in scoring.held_out_rows(b, data).collect()}
    prep = training.prepare_training(data, "Chuva", "rain_mm", key=["event_id"])
    assert held == {r["event_id"] for r in prep.data.where("is_test").collect()} and 0 < len(held) < data.count() / 4
    path = scratch_path(spark, "split-bundle")
    persist.save_bundle(b, path)
    assert persist.load_bundle(spark, path).split == b.split
    scored, out = scoring.test_models(b, data, "Chuva", "rain_mm")
    assert {r["event_id"] for r in scored.collect()} == held
    found = {r["metric"]: r["value"] for r in report.collect() if r["model"] == "classification"}
    assert math.isclose(out["classification"].first()["accuracy"], found["accuracy"])


def test_threshold_in_scoring(bundle, data):
    b, _ = bundle
    rows = scoring.score_batch(b, data, threshold=0.2).collect()
    assert all(r["vai_chover"] == int(r["prob_chuva"] >= 0.2) for r in rows)


def test_metadata_holds_the_scalar_metrics(spark, bundle):
    row = persist.metadata_frame(spark, bundle[0]).first()
    assert 0 <= row["classification_metrics"]["accuracy"] <= 1 and row["regression_metrics"]["rmse"] >= 0


def test_forests_read_rows_spread_evenly(spark, data, monkeypatch):
    from stratus.operators import encode, models, sampling

    read = []

    def fit(self, df, params=None):
        read.append([r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()])
        raise _Stop

    prep = training.prepare_training(data, "Chuva", "rain_mm", key=["event_id"])
    with pytest.raises(_Stop):
        monkeypatch.setattr(models.Pipeline, "fit", fit)
        models.rf_classifier(prep.features, "Chuva").fit(encode.with_class_weight(prep.data.where("not is_test"), "Chuva"))
    with pytest.raises(_Stop):
        training.train_models(data, ["event_id"], "Chuva", "rain_mm", num_trees=1, max_depth=1)  # its folds come first
    for sizes in read:
        assert len(sizes) >= spark.sparkContext.defaultParallelism and max(sizes) <= 2 * min(sizes)
    assert sampling.spread(data, 90, rows_per_task=10).rdd.getNumPartitions() == 9


def test_forests_read_rows_in_order_of_the_target(spark, data, monkeypatch):
    from stratus.operators import encode, models

    read = []

    def fit(self, df, params=None):
        read.append([r["mm"] for r in df.groupBy(F.spark_partition_id()).agg(F.collect_list("rain_mm").alias("mm")).collect()])
        raise _Stop

    prep = training.prepare_training(data, "Chuva", "rain_mm", key=["event_id"])
    monkeypatch.setattr(models.Pipeline, "fit", fit)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # the rows of a class are not brought together by any join
    try:
        with pytest.raises(_Stop):
            models.rf_regressor(prep.features, "rain_mm").fit(encode.with_class_weight(prep.data.where("not is_test"), "Chuva"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    with pytest.raises(_Stop):
        training.train_models(data, ["event_id"], "Chuva", "rain_mm", num_trees=1, max_depth=1)  # its folds come first
    for parts in read:
        assert len(parts) >= spark.sparkContext.defaultParallelism and all(mm == sorted(mm) for mm in parts)


class _Stop(Exception):
    pass


def test_queries_train_whole_forests(spark, monkeypatch):
    from types import SimpleNamespace

    from stratus.bindings import learning

    met = []

    def stop(*args, **options):
        met.append((options["num_trees"], options["max_depth"]) if options else args[-2:])
        raise _Stop

    monkeypatch.setattr(learning, "training_table", lambda spark, sf: None)
    monkeypatch.setattr(learning, "_split", lambda spark, sf: (SimpleNamespace(features=[]), None, None))
    monkeypatch.setattr(learning, "reliable_checkpoint", lambda df: df)
    monkeypatch.setattr(learning.sampling, "kfold", lambda *a, **k: None)
    monkeypatch.setattr(learning.training, "train_models", stop)
    monkeypatch.setattr(learning.models, "rf_classifier", stop)
    monkeypatch.setattr(learning.models, "rf_regressor", stop)
    runs = [lambda kind=kind: learning._cv(spark, None, kind) for kind in ("classification", "regression")]
    runs += [lambda q=q: q(spark, None) for q in (learning.q_feature_importance, learning.q_score_batch, learning.q_load_model, learning.q_sink_training_report)]
    for run in runs:
        with pytest.raises(_Stop):
            run()
    assert met == [(100, 10)] * len(runs)


def test_amount_forest_in_parts_is_whole(spark, data, monkeypatch):
    import threading

    from stratus.operators import models

    rows = data.select("event_id", "rain_mm", "signal", "noise")
    whole, meet = models.RandomForestRegressor.fit, threading.Barrier(3, timeout=120)

    def fit(self, df, params=None):
        meet.wait()  # passes only when all parts are fitted at the same time
        return whole(self, df)

    monkeypatch.setattr(models.RandomForestRegressor, "fit", fit)
    model = models.rf_regressor(["signal", "noise"], "rain_mm", num_trees=45, max_depth=4).fit(rows)
    parts = model.stages[1:-1]
    assert [p.getNumTrees for p in parts] == [20, 20, 5] and len({t.toDebugString.split("\n", 1)[1] for p in parts for t in p.trees}) > 40
    assert models.score_regressor(model, rows).columns == [*rows.columns, "quantidade_chuva_prevista_mm"]
    trees = [t for p in parts for t in p.trees]
    for r in models.score_regressor(model, models._assembler(["signal", "noise"]).transform(rows.limit(20)).withColumnRenamed(models.FEATURES_VEC, "v")).collect():
        assert math.isclose(r["quantidade_chuva_prevista_mm"], sum(t.predict(r["v"]) for t in trees) / 45)
    assert math.isclose(sum(r["importance"] for r in models.feature_importance(model, ["signal", "noise"]).collect()), 1)


def test_bundle_of_parts_scores_the_same_when_loaded(spark, data):
    b, report = training.train_models(data, ["event_id"], "Chuva", "rain_mm", num_trees=21, max_depth=3, cv_folds=2)
    assert sum(s.getNumTrees for s in b.regressor.stages[1:-1]) == 21 and {"cv_r2_fold1", "r2"} <= {r["metric"] for r in report.collect()}
    again = persist.load_bundle(spark, persist.save_bundle(b, scratch_path(spark, "parts-bundle")))
    found = [{r["event_id"]: r["quantidade_chuva_prevista_mm"] for r in scoring.score_batch(x, data).collect()} for x in (b, again)]
    assert found[0] == found[1] and len(found[0]) == data.count()


def test_parts_are_fitted_as_many_at_a_time_as_memory_holds(spark, data, monkeypatch):
    import threading

    from stratus.operators import models
    from stratus.session import storage_bytes

    assert storage_bytes(spark) > 0
    rows = data.select("event_id", "rain_mm", "signal", "noise")
    pipe = models.rf_regressor(["signal", "noise"], "rain_mm", num_trees=50, max_depth=3)
    whole, lock, running, most = models.RandomForestRegressor.fit, threading.Lock(), [], []

    def fit(self, df, params=None):
        with lock:
            running.append(self)
            most.append(len(running))
        model = whole(self, df)
        with lock:
            running.remove(self)
        return model

    monkeypatch.setattr(models.RandomForestRegressor, "fit", fit)
    trees = [[t.toDebugString.split("\n", 1)[1] for p in pipe.fit(rows).stages[1:-1] for t in p.trees]]
    assert max(most) > 1
    most.clear()
    monkeypatch.setattr(models, "storage_bytes", lambda spark: 1)
    trees.append([t.toDebugString.split("\n", 1)[1] for p in pipe.fit(rows).stages[1:-1] for t in p.trees])
    assert max(most) == 1 and trees[0] == trees[1]
    most.clear()
    folds = rows.withColumn("fold", (F.col("event_id") % 2).cast("int"))
    assert models.cross_validate(folds, pipe, "fold", "rain_mm", "regression", 2).count() == 2 and max(most) == 1


def test_forests_are_the_same_from_stored_vectors_and_kept_nodes(spark, data):
    from stratus.operators import models

    rows = data.select("event_id", "Chuva", "rain_mm", "signal", "noise").repartition(4, "event_id").sortWithinPartitions("event_id").checkpoint()
    for pipe in (models.rf_regressor(["signal", "noise"], "rain_mm", num_trees=21, max_depth=4), models.rf_classifier(["signal", "noise"], weight_col=None, num_trees=8, max_depth=4)):
        stored = models.assembled(rows, pipe).checkpoint()
        assert stored.columns == ["event_id", "Chuva", "rain_mm", models.FEATURES_VEC]
        forests = [s for s in pipe.getStages()[1:] if hasattr(s, "getCacheNodeIds")]
        assert all(f.getCacheNodeIds() for f in forests)
        found = [pipe.fit(rows), pipe.fit(stored)]
        for f in forests:
            f.setCacheNodeIds(False)
        found.append(pipe.fit(rows))
        texts = [[t.toDebugString.split("\n", 1)[1] for s in m.stages if hasattr(s, "trees") for t in s.trees] for m in found]
        assert texts[0] == texts[1] == texts[2] and len(texts[0]) in (21, 8)
        score = models.score_classifier if len(forests) == 1 else models.score_regressor
        out = [{r["event_id"]: r[-1] for r in score(found[0], x).collect()} for x in (rows, stored)]
        assert out[0] == out[1] and len(out[0]) == rows.count()


def test_training_stores_the_vectors_that_its_forests_read(data, monkeypatch):
    from stratus.operators import models

    read, whole = [], models.Pipeline.fit

    def fit(self, df, params=None):
        read.append((models.FEATURES_VEC in df.columns, "signal" in df.columns))
        return whole(self, df)

    monkeypatch.setattr(models.Pipeline, "fit", fit)
    training.train_models(data, ["event_id"], "Chuva", "rain_mm", num_trees=2, max_depth=2, cv_folds=2)
    assert read == [(True, False)] * 6
