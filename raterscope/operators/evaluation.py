"""Evaluation tables over scored rows ``(fold, label, score, prediction)``.

All functions read any such DataFrame; extra grouping columns such as ``model`` go into ``by``.
Groups are folds and models, so ``by`` has a handful of values, while scores may be of any number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import totals_before

_METRICS = ("precision", "recall", "f1")


def _ratio(over: str, under: str) -> str:
    """Quotient, 0 where the denominator is 0."""
    return f"coalesce(try_divide(double({over}), double({under})), 0D)"


def _score_counts(scored: DataFrame, by: Sequence[str], label: str, score: str) -> DataFrame:
    """Positives and negatives per distinct score, with those at strictly lower scores."""
    counts = scored.groupBy(*by, score).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )
    return totals_before(counts, by, score, ["pos", "neg"])


def _grouped(scored: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    if by:
        return scored, list(by)
    return scored.withColumn("_pool", F.lit(0)), ["_pool"]


def roc_auc(
    scored: DataFrame, by: Sequence[str] = ("fold",), label: str = "label", score: str = "score"
) -> DataFrame:
    """Area under the ROC curve per group; tied scores count half. Null with one class only."""
    data, keys = _grouped(scored, by)
    counts = _score_counts(data, keys, label, score)
    below = F.col("neg_before") + F.col("neg") * F.lit(0.5)
    areas = counts.groupBy(*keys).agg(
        F.sum(F.col("pos") * below).alias("_wins"),
        F.max("pos_total").alias("n_pos"),
        F.max("neg_total").alias("n_neg"),
    )
    pairs = F.col("n_pos").cast("double") * F.col("n_neg").cast("double")
    return areas.select(*by, "n_pos", "n_neg", F.try_divide(F.col("_wins"), pairs).alias("auc"))


def mean_fold_auc(
    scored: DataFrame,
    by: Sequence[str] = (),
    fold: str = "fold",
    label: str = "label",
    score: str = "score",
) -> DataFrame:
    """Average over folds of the per-fold area; not the same number as the pooled area."""
    per_fold = roc_auc(scored, [*by, fold], label, score)
    return per_fold.groupBy(*by).agg(F.avg("auc").alias("mean_fold_auc"))


def pooled_auc(
    scored: DataFrame, by: Sequence[str] = (), label: str = "label", score: str = "score"
) -> DataFrame:
    """Area over all folds' rows taken as one set."""
    return roc_auc(scored, by, label, score).select(*by, F.col("auc").alias("pooled_auc"))


def roc_points(
    scored: DataFrame, by: Sequence[str] = (), label: str = "label", score: str = "score"
) -> DataFrame:
    """ROC curve: one point per distinct score used as threshold, and the origin (null threshold)."""
    data, keys = _grouped(scored, by)
    counts = _score_counts(data, keys, label, score)
    caught = F.col("pos_total") - F.col("pos_before")
    alarms = F.col("neg_total") - F.col("neg_before")
    points = counts.select(
        *by,
        F.col(score).alias("threshold"),
        F.try_divide(alarms.cast("double"), F.col("neg_total").cast("double")).alias("fpr"),
        F.try_divide(caught.cast("double"), F.col("pos_total").cast("double")).alias("tpr"),
    )
    origin = data.select(*keys).distinct().select(
        *by, F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return points.unionByName(origin)


def confusion_matrix(
    scored: DataFrame, by: Sequence[str] = (), label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """Rows per true and predicted class; all four cells of each group are present."""
    cells = [(t, p) for t in (0, 1) for p in (0, 1)]
    counted = scored.groupBy(*by).agg(
        *[F.expr(f"count_if({label} = {t} AND {prediction} = {p}) AS _{t}{p}") for t, p in cells]
    )
    entries = [f"named_struct('label', {t}, 'prediction', {p}, 'n', _{t}{p})" for t, p in cells]
    return counted.select(*by, F.expr(f"inline(array({', '.join(entries)}))"))


def classification_report(
    scored: DataFrame,
    by: Sequence[str] = ("fold",),
    label: str = "label",
    prediction: str = "prediction",
) -> DataFrame:
    """Precision, recall, F1 and support of each class, macro and weighted averages, accuracy.

    One aggregation to four counts per group; the rest is arithmetic on them. Accuracy is held
    in all three metric columns of its row.
    """
    truth, guess = f"{label} = 1", f"{prediction} = 1"
    counts = scored.groupBy(*by).agg(
        F.expr(f"count_if({truth} AND {guess}) AS _tp"),
        F.expr(f"count_if({truth} AND NOT {guess}) AS _fn"),
        F.expr(f"count_if(NOT {truth} AND {guess}) AS _fp"),
        F.expr(f"count_if(NOT {truth} AND NOT {guess}) AS _tn"),
    )
    per_class = counts.selectExpr(
        *by,
        f"{_ratio('_tn', '_tn + _fn')} AS _p0",
        f"{_ratio('_tn', '_tn + _fp')} AS _r0",
        f"{_ratio('2 * _tn', '2 * _tn + _fn + _fp')} AS _f0",
        "_tn + _fp AS _n0",
        f"{_ratio('_tp', '_tp + _fp')} AS _p1",
        f"{_ratio('_tp', '_tp + _fn')} AS _r1",
        f"{_ratio('2 * _tp', '2 * _tp + _fp + _fn')} AS _f1",
        "_tp + _fn AS _n1",
        f"{_ratio('_tp + _tn', '_tp + _tn + _fp + _fn')} AS _accuracy",
    )
    total = "_n0 + _n1"
    macro = [f"(_{m}0 + _{m}1) / 2D" for m in "prf"]
    weighted = [_ratio(f"_{m}0 * _n0 + _{m}1 * _n1", total) for m in "prf"]
    rows = [
        ("0", ["_p0", "_r0", "_f0"], "_n0"),
        ("1", ["_p1", "_r1", "_f1"], "_n1"),
        ("accuracy", ["_accuracy"] * 3, total),
        ("macro avg", macro, total),
        ("weighted avg", weighted, total),
    ]
    entries = [
        f"named_struct('class', '{name}', 'precision', {p}, 'recall', {r}, 'f1', {f}, 'support', {n})"
        for name, (p, r, f), n in rows
    ]
    return per_class.select(*by, F.expr(f"inline(array({', '.join(entries)}))"))


def average_report(
    scored: DataFrame,
    by: Sequence[str] = (),
    fold: str = "fold",
    label: str = "label",
    prediction: str = "prediction",
) -> DataFrame:
    """The per-fold report averaged over folds; support is summed."""
    folds = classification_report(scored, [*by, fold], label, prediction)
    return folds.groupBy(*by, "class").agg(
        *[F.avg(m).alias(m) for m in _METRICS], F.sum("support").alias("support")
    )
