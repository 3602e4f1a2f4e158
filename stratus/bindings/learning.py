"""Encoders, class weights, evaluation metrics and the two forests."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from stratus.bindings import R, query
from stratus.bindings.fixtures import obs, scores, scores_sql, table
from stratus.bindings.fixtures import obs_sql as _obs_sql
from stratus.bindings.profiling import labelled, labelled_sql
from stratus.bindings.temporal import SCENARIO_YEAR, scenarios
from stratus.operators import encode, features, metrics, models, profile, sampling
from stratus.plans import scoring, training
from stratus.session import reliable_checkpoint, scratch_path
from stratus.sources import models as persist

PERIOD_SQL = (
    "CASE WHEN h >= 6 AND h < 12 THEN 'manha' WHEN h >= 12 AND h < 18 THEN 'tarde' "
    "WHEN h >= 18 AND h < 24 THEN 'noite' ELSE 'madrugada' END"
)
EVENT_TYPE = "CASE WHEN event_id % 50 = 0 THEN NULL ELSE event_type END"


def _categories(spark, sf):
    ev = table(spark, sf, "events")
    return ev.select(
        "event_id",
        features.C.day_period(F.hour("ts")).alias("periodo_dia"),
        F.expr(EVENT_TYPE).alias("event_type"),
    )


def _categories_sql():
    return f"(SELECT event_id, {PERIOD_SQL} AS periodo_dia, {EVENT_TYPE} AS event_type FROM (SELECT *, hour(ts) AS h FROM events) e)"


ENCODER_SQL = f"""SELECT "column", value, CAST(dense_rank() OVER (PARTITION BY "column" ORDER BY value) - 1 AS BIGINT) AS code FROM (
  SELECT DISTINCT 'periodo_dia' AS "column", coalesce(periodo_dia, 'nan') AS value FROM {_categories_sql()} c
  UNION SELECT DISTINCT 'event_type', coalesce(event_type, 'nan') FROM {_categories_sql()} c2) d"""


@query("label_encode_fit", ENCODER_SQL)
def q_label_encode_fit(spark, sf):
    """Sorted-value codes per text column; a missing value is the class 'nan'."""
    return encode.label_encode_fit(_categories(spark, sf), ["periodo_dia", "event_type"])


@query(
    "label_encode_apply",
    """SELECT p.p_partkey, CAST(coalesce(e.code, -1) AS BIGINT) AS p_type
FROM part p LEFT JOIN (SELECT value, dense_rank() OVER (ORDER BY value) - 1 AS code
                       FROM (SELECT DISTINCT coalesce(p_type, 'nan') AS value FROM part WHERE p_size <= 10) v) e
  ON coalesce(p.p_type, 'nan') = e.value""",
)
def q_label_encode_apply(spark, sf):
    """Fit on the small parts, apply to all: types never seen among them -> -1."""
    part = table(spark, sf, "part")
    enc = encode.label_encode_fit(part.where(F.col("p_size") <= 10), ["p_type"])
    return encode.label_encode_apply(part.select("p_partkey", "p_type"), enc, ["p_type"])


@query(
    "class_weights",
    f"SELECT Chuva, CAST(n AS BIGINT) AS n, {R('CAST(sum(n) OVER () AS DOUBLE) / (count(*) OVER () * n)')} AS weight FROM (SELECT Chuva, count(*) AS n FROM {labelled_sql()} l GROUP BY Chuva) c",
)
def q_class_weights(spark, sf):
    return encode.class_weights(labelled(spark, sf), "Chuva")


@query(
    "confusion_matrix",
    f"""SELECT CAST(a AS BIGINT) AS actual, CAST(b AS BIGINT) AS predicted, CAST(count(s.y_true) AS BIGINT) AS n
FROM range(0, 2) ta(a) CROSS JOIN range(0, 2) tb(b) LEFT JOIN {scores_sql()} s ON s.y_true = ta.a AND s.y_pred = tb.b GROUP BY a, b""",
)
def q_confusion_matrix(spark, sf):
    return metrics.confusion_matrix(scores(spark, sf))


def _cm_sql(src, t, p):
    return f"""(SELECT count(*) FILTER (WHERE {t} = 1 AND {p} = 1) AS tp, count(*) FILTER (WHERE {t} = 0 AND {p} = 1) AS fp,
        count(*) FILTER (WHERE {t} = 1 AND {p} = 0) AS fn, count(*) FILTER (WHERE {t} = 0 AND {p} = 0) AS tn FROM {src})"""


@query(
    "classification_metrics",
    f"""SELECT {R('(tp + tn) / (tp + tn + fp + fn)')} AS accuracy, {R('CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END')} AS precision,
       {R('CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END')} AS recall, {R('CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END')} AS f1,
       CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tp AS BIGINT) AS tp
FROM {_cm_sql(scores_sql() + ' s', 'y_true', 'y_pred')} c""",
)
def q_classification_metrics(spark, sf):
    return metrics.classification_metrics(scores(spark, sf))


def _report_sql():
    c = _cm_sql("labels", "quality", "toxic")
    p1, r1 = "CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END", "CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END"
    f1 = "CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END"
    p0, r0 = "CASE WHEN tn + fn = 0 THEN 0.0 ELSE tn / (tn + fn) END", "CASE WHEN tn + fp = 0 THEN 0.0 ELSE tn / (tn + fp) END"
    f0 = "CASE WHEN 2 * tn + fn + fp = 0 THEN 0.0 ELSE 2.0 * tn / (2 * tn + fn + fp) END"
    n, s1, s0 = "(tp + tn + fp + fn)", "(tp + fn)", "(tn + fp)"
    rows = [
        ("'0'", p0, r0, f0, s0),
        ("'1'", p1, r1, f1, s1),
        ("'accuracy'", "NULL", "NULL", f"(tp + tn) / {n}", n),
        ("'macro avg'", f"(({p0}) + ({p1})) / 2", f"(({r0}) + ({r1})) / 2", f"(({f0}) + ({f1})) / 2", n),
        ("'weighted avg'", f"(({p0}) * {s0} + ({p1}) * {s1}) / {n}", f"(({r0}) * {s0} + ({r1}) * {s1}) / {n}", f"(({f0}) * {s0} + ({f1}) * {s1}) / {n}", n),
    ]
    return "\nUNION ALL\n".join(
        f"SELECT {lbl} AS label, {R(pr)} AS precision, {R(rc)} AS recall, {R(f)} AS f1, CAST({sup} AS BIGINT) AS support FROM {c} c"
        for lbl, pr, rc, f, sup in rows
    )


@query("classification_report", _report_sql())
def q_classification_report(spark, sf):
    """Per-class report with quality as truth and toxic as prediction (labels table)."""
    return metrics.classification_report(table(spark, sf, "labels"), "quality", "toxic")


@query(
    "roc_auc",
    f"""WITH per AS (SELECT prob AS s, count(*) FILTER (WHERE y_true = 1) AS pos, count(*) FILTER (WHERE y_true <> 1) AS neg FROM {scores_sql()} x GROUP BY prob),
cum AS (SELECT s, pos, neg, sum(neg) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS fp FROM per),
tot AS (SELECT sum(pos) AS p, sum(neg) AS n FROM per)
SELECT {R('sum(pos * (n - fp) + 0.5 * pos * neg) / (first(p) * first(n))')} AS auc FROM cum, tot""",
)
def q_roc_auc(spark, sf):
    return metrics.roc_auc(scores(spark, sf), "y_true", "prob")


@query(
    "regression_metrics",
    f"""SELECT {R('sqrt(avg((amount - amount_pred) * (amount - amount_pred)))')} AS rmse, {R('avg(abs(amount - amount_pred))')} AS mae,
       {R('1.0 - sum((amount - amount_pred) * (amount - amount_pred)) / (var_pop(amount) * count(amount))')} AS r2, CAST(count(amount) AS BIGINT) AS n
FROM {scores_sql()} s""",
)
def q_regression_metrics(spark, sf):
    return metrics.regression_metrics(scores(spark, sf), "amount", "amount_pred")


@query(
    "residuals",
    f"""WITH v AS (SELECT amount - amount_pred AS x FROM {scores_sql()} s),
r AS (SELECT min(x) AS lo, max(x) AS hi FROM v),
counts AS (SELECT CAST(least(floor((x - lo) / (hi - lo) * 20), 19) AS BIGINT) AS bin, count(*) AS count FROM v, r GROUP BY 1)
SELECT CAST(b AS BIGINT) AS bin, {R('lo + b * ((hi - lo) / 20)')} AS lower, {R('lo + (b + 1) * ((hi - lo) / 20)')} AS upper, CAST(coalesce(count, 0) AS BIGINT) AS count
FROM range(0, 20) t(b) CROSS JOIN r LEFT JOIN counts ON counts.bin = t.b""",
)
def q_residuals(spark, sf):
    """Histogram (20 bins) of actual - predicted."""
    return profile.histogram(metrics.residuals(scores(spark, sf), "amount", "amount_pred"), "residual", 20)


@query(
    "actual_vs_predicted",
    f"SELECT {R('least(min(amount), min(amount_pred))')} AS lo, {R('greatest(max(amount), max(amount_pred))')} AS hi, CAST(count(*) AS BIGINT) AS n FROM {scores_sql()} s",
)
def q_actual_vs_predicted(spark, sf):
    return metrics.actual_vs_predicted(scores(spark, sf), "amount", "amount_pred")


# --- forests: their values have no SQL form; what must hold of them row by row has ---------

TREES, DEPTH = 100, 10
#: forests of the queries that show nothing of cross-validation
FORESTS = {"num_trees": TREES, "max_depth": DEPTH, "cv_folds": 0}
KEY = ["event_id"]


def training_table(spark, sf):
    """Observation rows with label, calendar and weather features (the processed table)."""
    o = features.rain_label(obs(spark, sf), "rain_mm")
    o = features.calendar_features(o.withColumn("datetime", F.col("ts")), "datetime")
    return features.weather_features(o).drop("ts")


def _train(spark, sf, **options):
    """Bundle and report of forests trained on the observation rows; every query trains its own."""
    return training.train_models(training_table(spark, sf), KEY, "Chuva", "rain_mm", exclude=["station_id"], **options)


def _prepare_sql():
    from stratus.bindings.fixtures import obs_sql

    season = "CASE WHEN month(ts) IN (12, 1, 2) THEN 'verao' WHEN month(ts) IN (3, 4, 5) THEN 'outono' WHEN month(ts) IN (6, 7, 8) THEN 'inverno' ELSE 'primavera' END"
    period = "CASE WHEN hour(ts) >= 6 AND hour(ts) < 12 THEN 'manha' WHEN hour(ts) >= 12 AND hour(ts) < 18 THEN 'tarde' WHEN hour(ts) >= 18 AND hour(ts) < 24 THEN 'noite' ELSE 'madrugada' END"
    base = f"(SELECT *, coalesce(event_type, 'nan') AS et, {season} AS es, {period} AS pd FROM {obs_sql()} o)"
    enc = lambda col: f"(SELECT value, dense_rank() OVER (ORDER BY value) - 1 AS code FROM (SELECT DISTINCT {col} AS value FROM {base} b) d)"
    plain = ["temp", "humidity", "pressure", "radiation", "wind_speed", "temp_max", "temp_min", "dew_point", "humidity_max", "humidity_min", "pressure_max", "pressure_min"]
    cal = {
        "ano": "year(ts)", "mes": "month(ts)", "dia": "day(ts)", "hora": "hour(ts)", "dia_semana": "isodow(ts) - 1",
        "dia_ano": "dayofyear(ts)", "semana_ano": "week(ts)",
        "hora_sin": "sin(2 * pi() * hour(ts) / 24)", "hora_cos": "cos(2 * pi() * hour(ts) / 24)",
        "mes_sin": "sin(2 * pi() * month(ts) / 12)", "mes_cos": "cos(2 * pi() * month(ts) / 12)",
        "fim_semana": "CASE WHEN isodow(ts) - 1 >= 5 THEN 1 ELSE 0 END",
        "amplitude_termica": "temp_max - temp_min", "spread_temp_orvalho": "temp - dew_point",
        "variacao_pressao": "pressure_max - pressure_min", "variacao_umidade": "humidity_max - humidity_min",
        "indice_desconforto": "temp - 0.55 * (1.0 - 0.01 * humidity) * (temp - 14.5)", "radiacao_norm": "radiation / 1000.0",
    }
    cols = [f"{R(c)} AS {c}" for c in plain] + [f"{R(e)} AS {n}" for n, e in cal.items()]
    cols += [f"{R('e1.code')} AS event_type", f"{R('e2.code')} AS estacao", f"{R('e3.code')} AS periodo_dia"]
    cols += ["CAST(CASE WHEN rain_mm > 0 THEN 1 ELSE 0 END AS BIGINT) AS Chuva", f"{R('rain_mm')} AS rain_mm", "event_id", "station_id", "ts AS datetime"]
    return (
        f"SELECT {', '.join(cols)} FROM {base} b JOIN {enc('et')} e1 ON b.et = e1.value "
        f"JOIN {enc('es')} e2 ON b.es = e2.value JOIN {enc('pd')} e3 ON b.pd = e3.value"
    )


@query("prepare_training", _prepare_sql())
def q_prepare_training(spark, sf):
    """Encoded, filtered and median-filled feature table."""
    p = training.prepare_training(training_table(spark, sf), "Chuva", "rain_mm", exclude=["event_id", "station_id"])
    return p.data


# the split takes the lowest hashes of each class; 20 % of each, rounded up
_CLASSES = "(SELECT CASE WHEN value > 60 THEN 1 ELSE 0 END AS y, count(*) AS n FROM events GROUP BY 1)"
_TEST_ROWS = f"(SELECT sum(ceil(0.2 * n)) FROM {_CLASSES} c)"


def _unit(c):
    return (F.col(c) >= 0) & (F.col(c) <= 1)


def _checked(scored):
    """What must hold of every scored row."""
    out = {}
    if "prob_chuva" in scored.columns:
        out["prob_ok"] = F.coalesce(_unit("prob_chuva"), F.lit(False))
        out["label_ok"] = F.col("previsao_chuva") == (F.col("prob_chuva") > 0.5).cast("int")
    if "quantidade_chuva_prevista_mm" in scored.columns:
        out["amount_ok"] = F.coalesce(F.col("quantidade_chuva_prevista_mm") >= 0, F.lit(False))
    return scored.select("event_id", *[v.alias(k) for k, v in out.items()])


CLASS_METRICS = ["accuracy", "precision", "recall", "f1", "tn", "fp", "fn", "tp"]
REG_METRICS = ["rmse", "mae", "r2", "n"]


def _metric_checks(report, *more):
    """Per metric: rates in [0, 1], errors not negative, R² at most 1; counts and folds are NULL here."""
    m, v = F.col("metric"), F.col("value")
    rate = m.isin("accuracy", "precision", "recall", "f1", "roc_auc") | m.startswith("cv_f1")
    ok = F.when(rate, (v >= 0) & (v <= 1)).when(m.isin("rmse", "mae") | m.endswith("_std"), v >= 0).when(m.startswith("r2") | m.startswith("cv_r2"), v <= 1)
    return report.select("model", "metric", F.coalesce(ok, v >= 0).alias("ok"), F.when(m.isin("tn", "fp", "fn", "tp"), v).alias("cell"), *more)


def _metrics_sql(folds):
    names = [("classification", m) for m in CLASS_METRICS] + [("regression", m) for m in REG_METRICS]
    for model, prefix in (("classification", "cv_f1"), ("regression", "cv_r2")):
        if folds:
            names += [(model, f"{prefix}_fold{i}") for i in range(folds)] + [(model, f"{prefix}_mean"), (model, f"{prefix}_std")]
    values = ", ".join(f"('{a}', '{b}')" for a, b in names)
    return f"SELECT model, metric, TRUE AS ok, CAST({_TEST_ROWS} AS DOUBLE) AS n_test FROM (VALUES {values}) v(model, metric)"


def _with_test_rows(checks):
    """The four cells of the confusion matrix add up to the test rows."""
    n = checks.agg(F.sum("cell").alias("n_test"))
    return checks.drop("cell").withColumn("n_test", n.scalar())


@query("train_models", _metrics_sql(5))
def q_train_models(spark, sf):
    """Training report (metrics, CV scores) of both forests: every metric in its range, and the test rows."""
    return _with_test_rows(_metric_checks(_train(spark, sf, num_trees=TREES, max_depth=DEPTH)[1]))


def _split(spark, sf):
    prep = training.prepare_training(training_table(spark, sf), "Chuva", "rain_mm", exclude=["station_id"], key=KEY)
    data = encode.with_class_weight(prep.data, "Chuva")
    return prep, data.where(~F.col("is_test")), data.where(F.col("is_test"))


@query("rf_classifier", f"SELECT y AS \"Chuva\", CAST(ceil(0.2 * n) AS BIGINT) AS n_rows, CAST(ceil(0.2 * n) AS BIGINT) AS n_ok FROM {_CLASSES} c")
def q_rf_classifier(spark, sf):
    """The event forest (100 trees, depth 10, balanced) on the held-out rows: per class, rows whose
    probabilities lie in [0, 1] and add up to 1 and whose label is the likelier class."""
    prep, train, test = _split(spark, sf)
    scored = models.score_classifier(models.rf_classifier(prep.features, "Chuva", "weight", TREES, DEPTH).fit(train), test)
    ok = _unit("prob_chuva") & _unit("prob_sem_chuva") & (F.abs(F.col("prob_chuva") + F.col("prob_sem_chuva") - 1) < 1e-9)
    ok = ok & (F.col("previsao_chuva") == (F.col("prob_chuva") > 0.5).cast("int"))
    return scored.groupBy("Chuva").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(ok).alias("n_ok"))


@query("rf_regressor", f"SELECT CAST({_TEST_ROWS} AS BIGINT) AS n_rows, CAST({_TEST_ROWS} AS BIGINT) AS n_ok, TRUE AS within_training_range")
def q_rf_regressor(spark, sf):
    """The amount forest on the held-out rows: amounts that are not negative, none above the training maximum."""
    prep, train, test = _split(spark, sf)
    scored = models.score_regressor(models.rf_regressor(prep.features, "rain_mm", TREES, DEPTH).fit(train), test)
    amount = F.col("quantidade_chuva_prevista_mm")
    top = train.agg(F.max("rain_mm")).scalar()
    return scored.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(amount >= 0).alias("n_ok"), F.bool_and(amount <= top + 1e-9).alias("within_training_range"))


def _cv(spark, sf, kind):
    prep, train, _ = _split(spark, sf)
    train = reliable_checkpoint(train)
    if kind == "classification":
        folds = sampling.kfold(train, 5, key=KEY, label="Chuva")
        pipe, label = models.rf_classifier(prep.features, "Chuva", "weight", TREES, DEPTH), "Chuva"
    else:
        h = sampling.hash_order(KEY)
        folds = sampling.kfold(train, 5, order=[h, *KEY], bucket=F.shiftright(h, 64 - sampling.HASH_BUCKET_BITS))
        pipe, label = models.rf_regressor(prep.features, "rain_mm", TREES, DEPTH), "rain_mm"
    folds = reliable_checkpoint(models.assembled(sampling.spread(folds, train.count(), order=["rain_mm", "Chuva"]), pipe))
    scores = models.cross_validate(folds, pipe, "fold", label, kind, 5)
    low = 0.0 if kind == "classification" else float("-inf")
    sizes = folds.groupBy("fold").agg(F.count(F.lit(1)).alias("n_test"))
    return scores.join(sizes, "fold").select("fold", "n_test", ((F.col("score") >= low) & (F.col("score") <= 1)).alias("score_ok"))


@query(
    "cross_val_f1",
    f"""SELECT CAST(f AS BIGINT) AS fold, CAST(sum(t // 5 + CASE WHEN f < t % 5 THEN 1 ELSE 0 END) AS BIGINT) AS n_test, TRUE AS score_ok
FROM (SELECT CAST(n - ceil(0.2 * n) AS BIGINT) AS t FROM {_CLASSES} c) s, range(0, 5) r(f) GROUP BY f""",
)
def q_cross_val_f1(spark, sf):
    """F1 of the event class on each of 5 stratified folds: the fold's rows, and a score in [0, 1]."""
    return _cv(spark, sf, "classification")


@query(
    "cross_val_r2",
    f"""SELECT CAST(f AS BIGINT) AS fold, CAST(t // 5 + CASE WHEN f < t % 5 THEN 1 ELSE 0 END AS BIGINT) AS n_test, TRUE AS score_ok
FROM (SELECT CAST(sum(n - ceil(0.2 * n)) AS BIGINT) AS t FROM {_CLASSES} c) s, range(0, 5) r(f)""",
)
def q_cross_val_r2(spark, sf):
    """R² of the amount forest on each of 5 contiguous folds: the fold's rows, and a score of at most 1."""
    return _cv(spark, sf, "regression")


FEATURES = [
    "event_type", "temp", "humidity", "pressure", "radiation", "wind_speed", "temp_max", "temp_min", "dew_point", "humidity_max", "humidity_min",
    "pressure_max", "pressure_min", "ano", "mes", "dia", "hora", "dia_semana", "dia_ano", "semana_ano", "hora_sin", "hora_cos", "mes_sin", "mes_cos",
    "estacao", "periodo_dia", "fim_semana", "amplitude_termica", "spread_temp_orvalho", "variacao_pressao", "variacao_umidade", "indice_desconforto", "radiacao_norm",
]


@query("feature_importance", "SELECT feature, TRUE AS importance_ok, TRUE AS adds_up FROM (VALUES " + ", ".join(f"('{f}')" for f in FEATURES) + ") v(feature)")
def q_feature_importance(spark, sf):
    """Every feature once; importances lie in [0, 1] and add up to 1."""
    bundle, _ = _train(spark, sf, **FORESTS)
    found = models.feature_importance(bundle.classifier, bundle.features)
    total = found.agg(F.sum("importance")).scalar()
    return found.select("feature", _unit("importance").alias("importance_ok"), (F.abs(total - 1) < 1e-9).alias("adds_up"))


@query("score_classifier", "SELECT event_id, TRUE AS prob_ok, TRUE AS label_ok FROM events")
def q_score_classifier(spark, sf):
    """Every row scored once: a probability in [0, 1] and the label it stands for."""
    bundle, _ = _train(spark, sf, **FORESTS)
    return _checked(scoring.score_batch(bundle, training_table(spark, sf)).drop("quantidade_chuva_prevista_mm"))


@query("score_regressor", "SELECT event_id, TRUE AS amount_ok FROM events")
def q_score_regressor(spark, sf):
    """Every row scored once: an amount that is not negative."""
    bundle, _ = _train(spark, sf, **FORESTS)
    return _checked(scoring.score_batch(bundle, training_table(spark, sf)).drop("prob_chuva"))


@query("score_batch", f"SELECT event_id, TRUE AS prob_ok, TRUE AS label_ok, TRUE AS amount_ok, TRUE AS decision_ok, {R('temp')} AS temp FROM {_obs_sql()} o")
def q_score_batch(spark, sf):
    """Input rows + predicted event, probability, amount and the decision at a threshold of 0.3."""
    bundle, _ = _train(spark, sf, **FORESTS)
    scored = scoring.score_batch(bundle, training_table(spark, sf), threshold=0.3)
    decision = (F.col("vai_chover") == (F.col("prob_chuva") >= 0.3).cast("int")) & (F.abs(F.col("delta_pp") - (F.col("prob_chuva") - 0.3) * 100) < 1e-9)
    return _checked(scored).join(scored.select("event_id", decision.alias("decision_ok"), "temp"), "event_id")


@query("score_scenarios", "SELECT event_id, TRUE AS prob_ok, TRUE AS label_ok, TRUE AS amount_ok FROM events")
def q_score_scenarios(spark, sf):
    """Every scenario row scored once."""
    bundle, _ = _train(spark, sf, **FORESTS)
    return _checked(scoring.score_scenarios(bundle, scenarios(spark, sf), SCENARIO_YEAR))


@query(
    "test_models",
    "SELECT model, metric, TRUE AS ok, CAST("
    + _TEST_ROWS
    + " AS DOUBLE) AS n_test FROM (VALUES "
    + ", ".join(f"('classification', '{m}')" for m in [*CLASS_METRICS, "roc_auc"])
    + ", "
    + ", ".join(f"('regression', '{m}')" for m in REG_METRICS)
    + ") v(model, metric)",
)
def q_test_models(spark, sf):
    """Evaluation of a bundle on the rows that its training left out (one row per metric)."""
    bundle, _ = _train(spark, sf, **FORESTS)
    _, out = scoring.test_models(bundle, training_table(spark, sf), "Chuva", "rain_mm")

    def long(model, frame):
        return frame.select(F.lit(model).alias("model"), F.inline(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).cast("double").alias("value")) for k in frame.columns])))

    auc = out["roc_auc"].select(F.lit("classification").alias("model"), F.lit("roc_auc").alias("metric"), F.col("auc").alias("value"))
    return _with_test_rows(_metric_checks(long("classification", out["classification"]).unionByName(auc).unionByName(long("regression", out["regression"]))))


@query("save_model", "SELECT event_id, TRUE AS same_label, TRUE AS same_prob, TRUE AS same_amount FROM events")
def q_save_model(spark, sf):
    """Save the bundle, load it back and score with both: no difference in any row."""
    bundle, _ = _train(spark, sf, **FORESTS)
    again = persist.load_bundle(spark, persist.save_bundle(bundle, scratch_path(spark, "bundle")))
    rows = training_table(spark, sf)
    a, b = (scoring.score_batch(x, rows).select("event_id", F.struct("previsao_chuva", "prob_chuva", "quantidade_chuva_prevista_mm").alias(n)) for x, n in ((bundle, "a"), (again, "b")))
    same = {"same_label": "previsao_chuva", "same_prob": "prob_chuva", "same_amount": "quantidade_chuva_prevista_mm"}
    return a.join(b, "event_id").select("event_id", *[(F.col(f"a.{c}") == F.col(f"b.{c}")).alias(n) for n, c in same.items()])


_META_SQL = f"SELECT '{persist.BUNDLE_VERSION}' AS version, CAST({len(FEATURES)} AS BIGINT) AS n_features, 'event_type,estacao,periodo_dia' AS encoded, CAST({_TEST_ROWS} AS DOUBLE) AS n_test, CAST(4 AS BIGINT) AS n_reg_metrics, 'event_id' AS split_key"


def _meta_row(meta):
    cells = [F.element_at("classification_metrics", k) for k in ("tn", "fp", "fn", "tp")]
    return meta.select(
        "version", F.col("n_features").cast("long").alias("n_features"), F.array_join("label_encoders_cols", ",").alias("encoded"), sum(cells[1:], cells[0]).alias("n_test"),
        F.size("regression_metrics").cast("long").alias("n_reg_metrics"), F.get_json_object("split", "$.key[0]").alias("split_key"),
    )


@query("load_model", _META_SQL)
def q_load_model(spark, sf):
    """A loaded bundle's metadata (feature count, encoded columns, metrics, split)."""
    bundle, _ = _train(spark, sf, **FORESTS)
    return _meta_row(persist.metadata_frame(spark, persist.load_bundle(spark, persist.save_bundle(bundle, scratch_path(spark, "bundle")))))


@query("save_metadata", _META_SQL)
def q_save_metadata(spark, sf):
    """The metadata table written as JSON and read back."""
    bundle, _ = _train(spark, sf, **FORESTS)
    path = os.path.join(scratch_path(spark, "meta"), "metadata")
    meta = persist.metadata_frame(spark, bundle)
    meta.write.mode("overwrite").json(path)
    return _meta_row(spark.read.schema(meta.schema).json(path))


def _report_sql():
    names = ", ".join(f"('{c}', {i}.0)" for i, c in enumerate(FEATURES, 1))
    return (
        f"SELECT model, metric, ok, n_test, CAST(NULL AS DOUBLE) AS number FROM ({_metrics_sql(5)}) m\n"
        f"UNION ALL SELECT 'features', name, TRUE, CAST({_TEST_ROWS} AS DOUBLE), CAST(number AS DOUBLE) FROM (VALUES {names}) f(name, number)"
    )


@query("sink_training_report", _report_sql())
def q_sink_training_report(spark, sf):
    """The training report (metrics, CV scores of every fold with mean and deviation, numbered features)
    written as JSON and read back."""
    path = scratch_path(spark, "report")
    bundle, report = _train(spark, sf, num_trees=TREES, max_depth=DEPTH)
    training.training_report(bundle, report).write.mode("overwrite").json(path)
    rows = spark.read.schema("model string, metric string, value double").json(path)
    number = F.when(F.col("model") == "features", F.col("value")).alias("number")
    return _with_test_rows(_metric_checks(rows, number))
