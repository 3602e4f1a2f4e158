"""Model bundle persistence: MLlib pipelines + encoder table + metadata in one folder."""

from __future__ import annotations

import datetime as _dt
import json
import os
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

BUNDLE_VERSION = "1.1"
#: in a split's bounds: the bound of rows of any label
ANY_LABEL = "*"


@dataclass
class ModelBundle:
    """Everything scoring needs: both models, feature order, medians and encoders; and how the rows
    were split (``key``, ``seed``, ``fraction``, ``label`` and the largest test hash per label)."""

    features: list[str]
    medians: dict[str, float]
    encoder: DataFrame | None
    encoded_columns: list[str]
    classifier: PipelineModel | None = None
    regressor: PipelineModel | None = None
    metrics: dict = field(default_factory=dict)
    split: dict = field(default_factory=dict)
    created_at: str = field(default_factory=lambda: _dt.datetime.now().isoformat())

    def metadata(self) -> dict:
        return {
            "version": BUNDLE_VERSION,
            "created_at": self.created_at,
            "feature_names": self.features,
            "feature_medians": self.medians,
            "n_features": len(self.features),
            "label_encoders_cols": self.encoded_columns,
            "metrics": self.metrics,
            "split": self.split,
        }


def save_bundle(bundle: ModelBundle, path: str) -> str:
    """Write models (MLlib format), encoder table (Parquet) and metadata (one-row JSON)."""
    spark = SparkSession.getActiveSession()
    if bundle.classifier is not None:
        bundle.classifier.write().overwrite().save(os.path.join(path, "classifier"))
    if bundle.regressor is not None:
        bundle.regressor.write().overwrite().save(os.path.join(path, "regressor"))
    save_encoders(bundle.encoder, os.path.join(path, "encoders"), spark)
    meta = spark.createDataFrame([(json.dumps(bundle.metadata(), ensure_ascii=False),)], "metadata string")
    meta.write.mode("overwrite").json(os.path.join(path, "metadata"))
    return path


def save_encoders(encoder: DataFrame | None, path: str, spark: SparkSession | None = None) -> str:
    """Encoder table; an empty table when nothing was encoded."""
    spark = spark or SparkSession.getActiveSession()
    if encoder is None:
        encoder = spark.createDataFrame([], "column string, value string, code long")
    encoder.write.mode("overwrite").parquet(path)
    return path


def load_bundle(spark: SparkSession, path: str) -> ModelBundle:
    """Load a bundle; a missing folder or a bundle without models is an error."""
    meta_rows = spark.read.json(os.path.join(path, "metadata")).select("metadata").collect()
    if not meta_rows:
        raise FileNotFoundError(f"no model metadata under {path}")
    meta = json.loads(meta_rows[0][0])
    encoder = spark.read.parquet(os.path.join(path, "encoders"))
    clf = _load_if_there(spark, os.path.join(path, "classifier"))
    reg = _load_if_there(spark, os.path.join(path, "regressor"))
    if clf is None and reg is None:
        raise FileNotFoundError(f"no model under {path}")
    return ModelBundle(
        features=list(meta["feature_names"]),
        medians={k: float(v) for k, v in (meta.get("feature_medians") or {}).items()},
        encoder=encoder,
        encoded_columns=list(meta.get("label_encoders_cols") or []),
        classifier=clf,
        regressor=reg,
        metrics=meta.get("metrics") or {},
        split=meta.get("split") or {},
        created_at=meta.get("created_at", ""),
    )


def _load_if_there(spark: SparkSession, path: str) -> PipelineModel | None:
    """The model under ``path``, None where there is no such folder; a broken model is an error."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    return PipelineModel.load(path) if there else None


def metadata_frame(spark: SparkSession, bundle: ModelBundle) -> DataFrame:
    """Metadata as a one-row DataFrame: names, medians, split and the scalar metrics of both models."""
    m = bundle.metadata()
    scalars = [{k: float(v) for k, v in (m["metrics"].get(model) or {}).items() if v is not None} for model in ("classification", "regression")]
    row = (m["version"], m["created_at"], m["feature_names"], m["n_features"], m["label_encoders_cols"], json.dumps(m["feature_medians"]), json.dumps(m["split"]))
    return spark.createDataFrame(
        [(*row, *scalars)],
        "version string, created_at string, feature_names array<string>, n_features int, label_encoders_cols array<string>, "
        "feature_medians string, split string, classification_metrics map<string,double>, regression_metrics map<string,double>",
    )
