"""Random-forest event / amount models on MLlib, cross-validation and scoring.

Training, prediction and evaluation are distributed MLlib / Spark SQL jobs; the driver
only loops over the five folds and reads back single-row metric tables.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratus.functions.numeric import clamp_non_negative
from stratus.operators import metrics as M
from stratus.session import storage_bytes

FEATURES_VEC = "__features"
MIN_TRAIN_ROWS = 10
#: trees of an amount forest that are fitted together
PART_TREES = 20
#: of the memory for cached rows, the share that fits at the same time may fill
MEMORY_SHARE = 0.8
#: each row's node in each tree is kept from level to level, not found anew from the root; no checkpoints of
#: that: there are few levels, and a lost part follows from the rows again
NODE_IDS = {"cacheNodeIds": True, "checkpointInterval": -1}


class Forest(Pipeline):
    """Pipeline of an assembler and a forest; rows that have the feature vector already are not assembled again."""

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        assembler, *forests = self.getStages()
        rows = dataset if FEATURES_VEC in dataset.columns else assembler.transform(dataset)
        return PipelineModel([assembler, *self._fit_forests(forests, rows)])

    def _fit_forests(self, forests: list, rows: DataFrame) -> list:
        return [rf.fit(rows) for rf in forests]

    def bytes_a_row(self) -> list[int]:
        """Memory that MLlib keeps for a row while each of the forests is fitted: the bins of its features, how
        often each tree has drawn it and at which node it is (an int each), and the objects around them."""
        n = len(self.getStages()[0].getInputCols())
        return [4 * (n + 2 * rf.getNumTrees()) + 160 for rf in self.getStages()[1:] if isinstance(rf, (RandomForestClassifier, RandomForestRegressor))]


class ForestParts(Forest):
    """Pipeline of an assembler, forests that are fitted side by side (none reads another's output) and the
    transformer that averages them.  As many are fitted at a time as keep their rows in the cluster's memory."""

    def _fit_forests(self, forests: list, rows: DataFrame) -> list:
        *forests, mean = forests
        room = fits_in_memory(rows, rows.count(), max(self.bytes_a_row()))
        with ThreadPoolExecutor(max_workers=max(1, min(len(forests), room))) as pool:
            return [*pool.map(lambda rf: rf.fit(rows), forests), mean]


def fits_in_memory(df: DataFrame, rows: int, bytes_a_row: int) -> int:
    """How many fits that keep ``rows`` rows each have room in the memory for cached rows.

    Beyond it, rows go to the executors' disks as serialized objects, and every level of the trees reads them back."""
    return int(MEMORY_SHARE * storage_bytes(df.sparkSession) / max(1, rows * bytes_a_row))


def assembled(df: DataFrame, pipeline: Pipeline) -> DataFrame:
    """``df`` with the feature vector of ``pipeline`` in place of the features: a forest reads its rows several
    times before it keeps them, and assembling them takes most of that."""
    assembler = pipeline.getStages()[0]
    return assembler.transform(df).drop(*assembler.getInputCols())


def _transform(model: PipelineModel, df: DataFrame) -> DataFrame:
    return PipelineModel(model.stages[1:] if FEATURES_VEC in df.columns else model.stages).transform(df)


def _assembler(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol=FEATURES_VEC, handleInvalid="keep")


def rf_classifier(
    features: Sequence[str],
    label: str = "Chuva",
    weight_col: str | None = "weight",
    num_trees: int = 100,
    max_depth: int = 10,
    min_instances_per_node: int = 2,
    seed: int = 42,
    max_bins: int = 32,
) -> Pipeline:
    """Assembler + random-forest classifier (√d features per split, balanced weights)."""
    rf = RandomForestClassifier(
        featuresCol=FEATURES_VEC,
        labelCol=label,
        numTrees=num_trees,
        maxDepth=max_depth,
        minInstancesPerNode=min_instances_per_node,
        featureSubsetStrategy="sqrt",
        seed=seed,
        maxBins=max_bins,
        maxMemoryInMB=1024,
        **NODE_IDS,
        predictionCol="__pred",
        probabilityCol="__prob",
        rawPredictionCol="__raw",
    )
    if weight_col:
        rf.setWeightCol(weight_col)
    return Forest(stages=[_assembler(features), rf])


def rf_regressor(
    features: Sequence[str],
    label: str,
    num_trees: int = 100,
    max_depth: int = 10,
    min_instances_per_node: int = 2,
    seed: int = 42,
    max_bins: int = 32,
) -> Pipeline:
    """Assembler + random-forest regressor (all features per split).

    More than ``PART_TREES`` trees are fitted in parts side by side, whose mean, weighted by their trees, is
    the forest's: a part's node statistics are smaller, and the tasks of one part fill the time in which
    another waits for its slowest task or for the driver.
    """
    sizes = [min(PART_TREES, num_trees - i) for i in range(0, num_trees, PART_TREES)]
    names = ["__pred"] if len(sizes) == 1 else [f"__pred{i}" for i in range(len(sizes))]
    forests = [
        RandomForestRegressor(
            featuresCol=FEATURES_VEC,
            labelCol=label,
            numTrees=n,
            maxDepth=max_depth,
            minInstancesPerNode=min_instances_per_node,
            featureSubsetStrategy="all",
            seed=seed + 1_000_003 * i,  # MLlib adds the partition's number to the seed
            maxBins=max_bins,
            maxMemoryInMB=256,
            **NODE_IDS,
            predictionCol=name,
        )
        for i, (n, name) in enumerate(zip(sizes, names))
    ]
    if len(forests) == 1:
        return Forest(stages=[_assembler(features), *forests])
    mean = " + ".join(f"{n} * {name}" for n, name in zip(sizes, names))
    mean = SQLTransformer(statement=f"SELECT * EXCEPT ({', '.join(names)}), ({mean}) / {num_trees} AS __pred FROM __THIS__")
    return ForestParts(stages=[_assembler(features), *forests, mean])


def check_rows(df: DataFrame, minimum: int = MIN_TRAIN_ROWS) -> None:
    n = df.limit(minimum).count()
    if n < minimum:
        raise ValueError(f"not enough rows to train: {n} < {minimum}")


def score_classifier(model: PipelineModel, df: DataFrame, label_out: str = "previsao_chuva", prob_out: str = "prob_chuva", prob0_out: str | None = "prob_sem_chuva") -> DataFrame:
    """Predicted class and class probabilities appended to the input rows."""
    out = _transform(model, df)
    prob = vector_to_array("__prob")
    cols = {label_out: F.col("__pred").cast("int"), prob_out: prob[1]}
    if prob0_out:
        cols[prob0_out] = prob[0]
    return out.withColumns(cols).drop(FEATURES_VEC, "__pred", "__prob", "__raw")


def score_regressor(model: PipelineModel, df: DataFrame, out: str = "quantidade_chuva_prevista_mm") -> DataFrame:
    """Predicted amount, clamped at 0."""
    return _transform(model, df).withColumn(out, clamp_non_negative("__pred")).drop(FEATURES_VEC, "__pred")


def feature_importance(model: PipelineModel, features: Sequence[str], top: int | None = None) -> DataFrame:
    """(feature, importance) sorted by importance (model metadata, one value per feature)."""
    spark = _spark_of(model)
    forests = [s for s in model.stages if isinstance(s, (RandomForestClassificationModel, RandomForestRegressionModel))]
    imp = sum(f.featureImportances.toArray() * f.getNumTrees for f in forests)
    imp = (imp / (imp.sum() or 1.0)).tolist()
    df = spark.createDataFrame([(f, float(v)) for f, v in zip(features, imp)], "feature string, importance double")
    df = df.orderBy(F.col("importance").desc(), "feature")
    return df.limit(top) if top else df


def _spark_of(model):
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession()


def cross_validate(
    df: DataFrame,
    pipeline: Pipeline,
    fold_col: str,
    label: str,
    kind: str = "classification",
    k: int = 5,
    parallelism: int | None = None,
) -> DataFrame:
    """Per-fold score (F1 of class 1, or R²) fitting on the other folds.

    Folds are fitted concurrently (Spark runs jobs submitted from several driver threads
    side by side, as MLlib's ``CrossValidator(parallelism=…)`` does); fewer at a time where a
    forest has parts, as each part keeps the rows it reads, and where those of several folds are more
    than the cluster's memory holds.  Rows may have the feature vector already (:func:`assembled`).  Returns
    ``fold, score`` rows; see :func:`cv_summary` for mean and (population) std.
    """
    spark = df.sparkSession
    if not parallelism and isinstance(pipeline, Forest):
        kept = pipeline.bytes_a_row()
        room = fits_in_memory(df, df.count() * (k - 1) // k, sum(kept))
        parallelism = max(1, min(k, 2 * k // len(kept), room))

    def one(f: int) -> tuple[int, float | None]:
        train = df.where(F.col(fold_col) != f)
        test = df.where(F.col(fold_col) == f)
        model = pipeline.fit(train)
        if kind == "classification":
            pred = score_classifier(model, test, label_out="__y", prob_out="__p", prob0_out=None)
            m = M.classification_metrics(pred, label, "__y").select("f1").first()[0]
        else:
            pred = score_regressor(model, test, out="__y")
            m = M.regression_metrics(pred, label, "__y").select("r2").first()[0]
        return f, (float(m) if m is not None else None)

    with ThreadPoolExecutor(max_workers=parallelism or k) as pool:
        rows = list(pool.map(one, range(k)))
    return spark.createDataFrame(rows, "fold int, score double")


def cv_summary(scores: DataFrame) -> DataFrame:
    return scores.agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.count("score").cast("long").alias("folds"))


def population_std(values: Sequence[float]) -> float:
    m = sum(values) / len(values)
    return math.sqrt(sum((v - m) ** 2 for v in values) / len(values))
