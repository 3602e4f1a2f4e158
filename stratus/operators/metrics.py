"""Evaluation metrics computed from score tables with Spark SQL aggregates.

Ranking metrics (ROC points, AUC) need running totals over the score order.  Scores are
first collapsed to distinct values with per-score positive/negative counts (map-side
combine: a hot score is one row per task), then running sums are taken in two levels —
per range of scores, then within each range; ranges hold about as many scores each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratus.operators.ranges import RANGE, range_buckets


def confusion_matrix(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """All four cells (actual, predicted, n) for a 0/1 problem, zeros included."""
    t, p = F.col(y_true).cast("int"), F.col(y_pred).cast("int")
    wide = df.agg(*[F.count_if((t == a) & (p == b)).alias(f"c{a}{b}") for a in (0, 1) for b in (0, 1)])
    return wide.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(a).cast("long").alias("actual"), F.lit(b).cast("long").alias("predicted"), F.col(f"c{a}{b}").cast("long").alias("n"))
                    for a in (0, 1)
                    for b in (0, 1)
                ]
            )
        )
    )


def classification_metrics(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """accuracy, precision, recall, F1 of class 1 (0 when undefined) and the four counts."""
    t, p = F.col(y_true).cast("int"), F.col(y_pred).cast("int")
    c = df.agg(
        F.count_if((t == 1) & (p == 1)).alias("tp"),
        F.count_if((t == 0) & (p == 1)).alias("fp"),
        F.count_if((t == 1) & (p == 0)).alias("fn"),
        F.count_if((t == 0) & (p == 0)).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    prec = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))
    rec = F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    return c.select(
        F.coalesce(F.try_divide(tp + tn, tp + tn + fp + fn), F.lit(0.0)).alias("accuracy"),
        prec.alias("precision"),
        rec.alias("recall"),
        F.coalesce(F.try_divide(F.lit(2.0) * tp, F.lit(2.0) * tp + fp + fn), F.lit(0.0)).alias("f1"),
        *[F.col(x).cast("long").alias(x) for x in ("tn", "fp", "fn", "tp")],
    )


def classification_report(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Per class precision/recall/F1/support, then accuracy, macro and weighted averages."""
    t, p = F.col(y_true).cast("int"), F.col(y_pred).cast("int")
    c = df.agg(*[F.count_if((t == a) & (p == b)).alias(f"c{a}{b}") for a in (0, 1) for b in (0, 1)])
    rows = []
    for k in (0, 1):
        o = 1 - k
        tp, fp, fn = F.col(f"c{k}{k}").cast("double"), F.col(f"c{o}{k}").cast("double"), F.col(f"c{k}{o}").cast("double")
        rows.append(
            (
                str(k),
                F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)),
                F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0)),
                F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)),
                tp + fn,
            )
        )
    n = rows[0][4] + rows[1][4]
    acc = F.coalesce(F.try_divide(F.col("c00") + F.col("c11"), n), F.lit(0.0))
    macro = [(rows[0][i] + rows[1][i]) / 2 for i in (1, 2, 3)]
    weighted = [F.coalesce(F.try_divide(rows[0][i] * rows[0][4] + rows[1][i] * rows[1][4], n), F.lit(0.0)) for i in (1, 2, 3)]
    nul = F.lit(None).cast("double")
    table = [*rows, ("accuracy", nul, nul, acc, n), ("macro avg", *macro, n), ("weighted avg", *weighted, n)]
    return c.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(lbl).alias("label"), pr.alias("precision"), rc.alias("recall"), f1.alias("f1"), sup.cast("long").alias("support"))
                    for lbl, pr, rc, f1, sup in table
                ]
            )
        )
    )


def _score_totals(df: DataFrame, y_true: str, score: str) -> DataFrame:
    """Distinct scores (descending) with pos/neg counts and running totals up to each score.

    The distinct scores are written in range buckets of about equal size while the plan is built.
    """
    s = F.col(score).cast("double")
    per = df.where(s.isNotNull()).groupBy(s.alias("score")).agg(
        F.count_if(F.col(y_true).cast("int") == 1).alias("pos"), F.count_if(F.col(y_true).cast("int") != 1).alias("neg")
    )
    per = range_buckets(per, F.col("score").desc())
    per_bucket = per.groupBy(RANGE).agg(F.sum("pos").alias("bp"), F.sum("neg").alias("bn"))
    before = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = per_bucket.select(RANGE, F.coalesce(F.sum("bp").over(before), F.lit(0)).alias("op"), F.coalesce(F.sum("bn").over(before), F.lit(0)).alias("on"))
    inside = Window.partitionBy(RANGE).orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    local = per.withColumns({"lp": F.sum("pos").over(inside), "ln": F.sum("neg").over(inside)})
    return local.join(offsets, RANGE).select("score", "pos", "neg", (F.col("op") + F.col("lp")).alias("tp"), (F.col("on") + F.col("ln")).alias("fp"))


def roc_curve(df: DataFrame, y_true: str = "y_true", score: str = "prob") -> DataFrame:
    """ROC points (threshold, fpr, tpr) at every distinct score, plus the (inf, 0, 0) start."""
    tot = _score_totals(df, y_true, score)
    P = df.select(F.count_if(F.col(y_true).cast("int") == 1)).scalar()
    N = df.select(F.count_if(F.col(y_true).cast("int") != 1)).scalar()
    pts = tot.select(
        F.col("score").alias("threshold"),
        F.try_divide(F.col("fp").cast("double"), N.cast("double")).alias("fpr"),
        F.try_divide(F.col("tp").cast("double"), P.cast("double")).alias("tpr"),
    )
    start = df.sparkSession.range(1).select(F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return start.unionByName(pts)


def roc_auc(df: DataFrame, y_true: str = "y_true", score: str = "prob") -> DataFrame:
    """Area under the ROC curve (ties count half), i.e. the Mann-Whitney statistic.

    With ``fp(s)`` the negatives scored at or above ``s``, negatives strictly below are
    ``N - fp(s)``; every term is a plain aggregate over the distinct-score table.
    """
    tot = _score_totals(df, y_true, score)
    pos, neg, fp = (F.col(c).cast("double") for c in ("pos", "neg", "fp"))
    P, N = F.sum(pos), F.sum(neg)
    u = P * N - F.sum(pos * fp) + F.lit(0.5) * F.sum(pos * neg)
    return tot.agg(F.try_divide(u, P * N).alias("auc"))


def regression_metrics(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """RMSE, MAE and R² over rows with both values present."""
    ok = F.col(y_true).isNotNull() & F.col(y_pred).isNotNull()
    y = F.when(ok, F.col(y_true).cast("double"))
    e = F.when(ok, F.col(y_true).cast("double") - F.col(y_pred).cast("double"))
    return df.agg(
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        (F.lit(1.0) - F.try_divide(F.sum(e * e), F.var_pop(y) * F.count(y))).alias("r2"),
        F.count(y).cast("long").alias("n"),
    )


def residuals(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    return df.withColumn("residual", F.col(y_true).cast("double") - F.col(y_pred).cast("double"))


def actual_vs_predicted(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Joint range of actual and predicted values (the diagonal of the scatter) and pair count."""
    return df.agg(
        F.least(F.min(y_true), F.min(y_pred)).cast("double").alias("lo"),
        F.greatest(F.max(y_true), F.max(y_pred)).cast("double").alias("hi"),
        F.count(F.lit(1)).cast("long").alias("n"),
    )
