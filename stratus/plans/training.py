"""Training composites: prepared table -> two forests, metrics, persisted bundle."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratus.functions.roles import TRAINING_EXCLUDED_COLUMNS, resolve_time_columns
from stratus.operators import clean, encode, fill, metrics, models, sampling
from stratus.operators.stats import numeric_columns
from stratus.session import reliable_checkpoint, shared_table, wide_plans
from stratus.sources.models import ANY_LABEL, ModelBundle


@dataclass
class Prepared:
    """``data`` with filled features; with a key it has ``is_test``, and ``split`` tells how."""

    data: DataFrame
    features: list[str]
    medians: dict[str, float]
    encoder: DataFrame | None
    encoded_columns: list[str]
    split: dict = field(default_factory=dict)


def prepare_training(
    df: DataFrame,
    target_class: str = "Chuva",
    target_reg: str | None = None,
    exclude: Sequence[str] = (),
    max_null_fraction: float = 0.5,
    key: Sequence[str] | None = None,
    test_fraction: float = 0.2,
    seed: int = 42,
    legacy: bool = False,
) -> Prepared:
    """Features = all columns but time columns, identifiers and targets; text columns are
    label-encoded; rows with > 50 % missing features or a missing target are dropped;
    remaining gaps take the feature median (0 for an all-missing feature).

    With ``key`` the rows are split and the medians come from the training rows only;
    ``legacy`` takes them from all rows, before the split (as does a call without ``key``).
    """
    if target_class not in df.columns:
        raise ValueError(f"target column {target_class!r} not found")
    # keyword-found date/hour columns are dropped only when they hold text or time values
    # (a numeric column such as RADIACAO matches the keyword DIA and stays a feature)
    found = [c for c in resolve_time_columns(df.columns).values() if c not in numeric_columns(df)]
    skip = set(TRAINING_EXCLUDED_COLUMNS) | set(found) | set(exclude) | set(key or ())
    targets = [target_class] + ([target_reg] if target_reg and target_reg in df.columns else [])
    feats = [c for c in df.columns if c not in skip and c not in targets]
    text = [c for c in feats if df.schema[c].dataType.typeName() == "string"]
    with wide_plans(df.sparkSession):
        encoder = shared_table(encode.label_encode_fit(df, text), "encoder") if text else None
        # cut the lineage once the categories are coded: everything below re-reads these rows
        data = reliable_checkpoint(encode.label_encode_apply(df, encoder, text) if text else df)
        feats = [c for c in feats if c in text or c in numeric_columns(data)]
        data = clean.drop_sparse_rows(data, feats, targets, max_null_fraction)
        data = data.select(*feats, *targets, *[c for c in data.columns if c not in feats and c not in targets])
        data = data.withColumns({c: F.col(c).cast("double") for c in feats})
        split: dict = {}
        if key:
            rows = data.count()
            # forests read these partitions: they keep far more per row than a shuffle weighs
            data = reliable_checkpoint(sampling.spread(sampling.stratified_split(data, key, target_class, test_fraction, seed), rows, order=targets[::-1]))
            split = {"key": list(key), "seed": seed, "fraction": test_fraction, "label": target_class, "bounds": _bounds(data, key, seed, target_class)}
        known = data.where(~F.col("is_test")) if key and not legacy else data
        medians = {c: float(m) if m is not None else 0.0 for c, m in fill.medians(known, feats).items()}
    data = data.withColumns({c: F.coalesce(F.col(c), F.lit(medians.get(c, 0.0))) for c in feats})
    return Prepared(data, feats, medians, encoder, text, split)


def _bounds(data: DataFrame, key: Sequence[str], seed: int, label: str) -> dict[str, int]:
    """Largest hash of a test row per class: the split takes each class's lowest hashes, so a row's
    side follows from its key and class.  One entry where the classes were split together."""
    h = sampling.hash_order(key, seed)
    rows = data.groupBy(label).agg(F.max(F.when(F.col("is_test"), h)).alias("top"), F.min(F.when(~F.col("is_test"), h)).alias("rest")).collect()
    together = [r["top"] for r in rows if r["top"] is not None]
    if any(r["top"] is None for r in rows):  # only a split of all classes together leaves one without test rows
        return {ANY_LABEL: max(together)} if together else {}
    return {"" if r[label] is None else str(r[label]): r["top"] for r in rows}


def train_models(
    df: DataFrame,
    key: Sequence[str],
    target_class: str = "Chuva",
    target_reg: str | None = None,
    num_trees: int = 100,
    max_depth: int = 10,
    test_fraction: float = 0.2,
    cv_folds: int = 5,
    seed: int = 42,
    exclude: Sequence[str] = (),
    legacy: bool = False,
) -> tuple[ModelBundle, DataFrame]:
    """Fit the event classifier (and the amount regressor when ``target_reg`` is given).

    Returns the bundle and a one-row-per-metric report DataFrame.  ``key`` identifies a
    row (hash order of split and folds); both models are tested on the same held-out rows.
    ``cv_folds=0`` leaves cross-validation out.  ``legacy``: see :func:`prepare_training`.
    """
    prep = prepare_training(df, target_class, target_reg, exclude, key=key, test_fraction=test_fraction, seed=seed, legacy=legacy)
    clf_pipe = models.rf_classifier(prep.features, target_class, "weight", num_trees, max_depth, seed=seed)
    data = reliable_checkpoint(models.assembled(prep.data, clf_pipe))  # reused by folds, fits and evaluation
    models.check_rows(data)
    rows, order = data.count(), [target_reg, target_class] if target_reg else [target_class]
    train, test = data.where(~F.col("is_test")), data.where(F.col("is_test"))
    train = encode.with_class_weight(train, target_class)
    report = []
    cv = []
    if cv_folds:
        folds = reliable_checkpoint(sampling.spread(sampling.kfold(train, cv_folds, key=key, label=target_class, seed=seed), rows, order=order))
        cv = models.cross_validate(folds, clf_pipe, "fold", target_class, "classification", cv_folds).collect()
    pipes, rcv = [clf_pipe], []
    if target_reg:
        pipes.append(models.rf_regressor(prep.features, target_reg, num_trees, max_depth, seed=seed))
        if cv_folds:
            h = sampling.hash_order(key, seed)
            rfolds = sampling.kfold(train, cv_folds, key=key, label=None, order=[h, *key], bucket=F.shiftright(h, 64 - sampling.HASH_BUCKET_BITS))
            rfolds = reliable_checkpoint(sampling.spread(rfolds, rows, order=order))
            rcv = models.cross_validate(rfolds, pipes[1], "fold", target_reg, "regression", cv_folds).collect()
    kept = sum(sum(pipe.bytes_a_row()) for pipe in pipes)
    # both forests at the same time where both keep their rows in memory
    with ThreadPoolExecutor(max_workers=len(pipes) if models.fits_in_memory(train, rows, kept) else 1) as pool:
        clf, reg = [*pool.map(lambda pipe: pipe.fit(train), pipes), None][:2]
    scored = models.score_classifier(clf, test)
    cm = metrics.classification_metrics(scored, target_class, "previsao_chuva").first().asDict()
    report += [("classification", k, float(v)) for k, v in cm.items()]
    scores = [r["score"] for r in cv]
    report += [("classification", f"cv_f1_fold{r['fold']}", r["score"]) for r in cv]
    if scores:
        report += [("classification", "cv_f1_mean", sum(scores) / len(scores)), ("classification", "cv_f1_std", models.population_std(scores))]
    if target_reg:
        rscored = models.score_regressor(reg, test, out="__mm")
        rm = metrics.regression_metrics(rscored, target_reg, "__mm").first().asDict()
        report += [("regression", k, float(v)) for k, v in rm.items() if v is not None]
        rscores = [r["score"] for r in rcv]
        report += [("regression", f"cv_r2_fold{r['fold']}", r["score"]) for r in rcv]
        if rscores:
            report += [("regression", "cv_r2_mean", sum(rscores) / len(rscores)), ("regression", "cv_r2_std", models.population_std(rscores))]
    spark = df.sparkSession
    report_df = spark.createDataFrame(report, "model string, metric string, value double")
    bundle = ModelBundle(
        features=prep.features,
        medians=prep.medians,
        encoder=prep.encoder,
        encoded_columns=prep.encoded_columns,
        classifier=clf,
        regressor=reg,
        split=prep.split,
        metrics={m: {k: v for mm, k, v in report if mm == m} for m in ("classification", "regression")},
    )
    return bundle, report_df


def training_report(bundle: ModelBundle, report: DataFrame) -> DataFrame:
    """The report of :func:`train_models` and the numbered list of the features used: ``(model, metric,
    value)``, where a feature is a metric of model ``features`` and its number the value."""
    names = [("features", name, float(i)) for i, name in enumerate(bundle.features, 1)]
    return report.unionByName(report.sparkSession.createDataFrame(names, report.schema)) if names else report
