"""Stratified cross-validation, model comparison, learning curve and final fit."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from contextvars import copy_context
from dataclasses import dataclass
from functools import partial, reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import CORE_FEATURES
from ..session import cut_lineage
from .boosting import BoostedModel, BoostedTrees, score_many
from .classifiers import Builder
from .cleaning import is_number
from .evaluation import mean_fold_auc, roc_auc
from .forest import ForestModel, RandomForest
from .kernel import KernelModel, KernelSvm
from .knn import knn_classify
from .splits import learning_subsets

ROWS_PER_PARTITION = 100_000
# Estimators that fit the models of all folds together, and their models.
Together = BoostedTrees | KernelSvm | RandomForest
NativeModel = BoostedModel | KernelModel | ForestModel
Model = PipelineModel | NativeModel


@dataclass(frozen=True)
class FoldedTable:
    """A labelled table with folds, written once, and the rows in each fold."""

    df: DataFrame
    fold_rows: dict[int, int]

    @property
    def n_rows(self) -> int:
        return sum(self.fold_rows.values())


def prepare_folds(
    folded: DataFrame,
    features: Sequence[str] = CORE_FEATURES,
    label: str = "ai_label",
    user_col: str = "user_id",
    fold: str = "fold",
) -> FoldedTable:
    """Cut the lineage of a table with folds and bring its partitions to a useful size.

    Every fit scans the table many times. A small table in many partitions spends its time on
    task overhead, so partitions are merged until each has about ``ROWS_PER_PARTITION`` rows.
    """
    narrow = folded.select(user_col, F.col(label).cast("double").alias(label), *features, fold)
    # All models are fitted and compared on the same rows: those with every feature defined.
    for feature in features:
        narrow = narrow.filter(is_number(feature))
    narrow = cut_lineage(narrow)
    rows = {r[fold]: r["count"] for r in narrow.groupBy(fold).count().collect()}
    wanted = max(1, -(-sum(rows.values()) // ROWS_PER_PARTITION))
    return FoldedTable(narrow.coalesce(wanted), rows)


def score_column(model: Model, columns: Sequence[str]):
    """Probability of class 1, or the margin for models without probabilities."""
    if isinstance(model, NativeModel):
        return F.col("score")
    return vector_to_array("probability" if "probability" in columns else "rawPrediction")[1]


def _scored(model: Model, rows: DataFrame, user_col: str, label: str) -> DataFrame:
    out = model.transform(rows)
    return out.select(
        user_col,
        F.col(label).alias("label"),
        F.col("prediction").cast("double").alias("prediction"),
        score_column(model, out.columns).alias("score"),
    )


def _in_threads(task, items: Sequence, parallelism: int, spark) -> list:
    if parallelism <= 1 or len(items) <= 1:
        return [task(item) for item in items]
    # Tables that a thread writes belong to the scope of the caller; scopes that it opens are its own.
    context = copy_context()
    with ThreadPool(min(parallelism, len(items))) as pool:
        return pool.map(inheritable_thread_target(spark)(lambda item: context.copy().run(task, item)), items, 1)


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _training_rows(table: FoldedTable, label: str, fold: str, features: Sequence[str]) -> DataFrame:
    """Each row once for every fold that it helps to train."""
    folds = F.array(*[F.lit(f).cast("int") for f in sorted(table.fold_rows)])
    rows = table.df.withColumn("held_out", F.explode(folds)).filter(F.col("held_out") != F.col(fold))
    return rows.select(F.col(label).alias("label"), *features, "held_out")


def _fits_together(build: Builder | Together, features: Sequence[str]) -> bool:
    return build.together(features) if isinstance(build, RandomForest) else isinstance(build, Together)


def fit_folds(
    table: FoldedTable,
    build: Builder | Together,
    features: Sequence[str] = CORE_FEATURES,
    label: str = "ai_label",
    fold: str = "fold",
    parallelism: int = 3,
) -> dict[int, Model]:
    """One model per fold, trained on the other folds: all together where the estimator can, else in driver threads."""
    if _fits_together(build, features):
        return build.fit_together(_training_rows(table, label, fold, features), features, sorted(table.fold_rows), table.n_rows)

    def fit(held_out: int) -> tuple[int, PipelineModel]:
        pipeline = build(label, features, table.n_rows - table.fold_rows[held_out])
        return held_out, pipeline.fit(table.df.filter(F.col(fold) != held_out))

    return dict(_in_threads(fit, sorted(table.fold_rows), parallelism, table.df.sparkSession))


def out_of_fold(
    table: FoldedTable,
    models: Mapping[int, Model],
    name: str,
    label: str = "ai_label",
    user_col: str = "user_id",
    fold: str = "fold",
) -> DataFrame:
    """Every row scored once, by the model that did not see it."""
    parts = [
        _scored(model, table.df.filter(F.col(fold) == held_out), user_col, label).withColumn(
            "fold", F.lit(held_out)
        )
        for held_out, model in sorted(models.items())
    ]
    return _union(parts).select(F.lit(name).alias("model"), "fold", user_col, "label", "prediction", "score")


def cross_validate(
    table: FoldedTable, build: Builder | Together, name: str, parallelism: int = 3, **columns
) -> DataFrame:
    """Fit on all folds and return the out-of-fold scores."""
    features = columns.pop("features", CORE_FEATURES)
    shared = {k: v for k, v in columns.items() if k in ("label", "fold")}
    models = fit_folds(table, build, features, parallelism=parallelism, **shared)
    return out_of_fold(table, models, name, **columns)


def cross_validate_knn(
    table: FoldedTable,
    k: int = 5,
    features: Sequence[str] = CORE_FEATURES,
    label: str = "ai_label",
    user_col: str = "user_id",
    fold: str = "fold",
    name: str = "nearest_neighbours",
    parallelism: int = 3,
) -> DataFrame:
    """Out-of-fold scores of the nearest-neighbour classifier."""

    def classify(held_out: int) -> DataFrame:
        inside = F.col(fold) == held_out
        query = table.df.filter(inside)
        scored = knn_classify(table.df.filter(~inside), query, features, label, user_col, k)
        truth = query.select(user_col, F.col(label).alias("label"))
        return scored.join(truth, user_col).withColumn("fold", F.lit(held_out))

    parts = _in_threads(classify, sorted(table.fold_rows), parallelism, table.df.sparkSession)
    return _union(parts).select(F.lit(name).alias("model"), "fold", user_col, "label", "prediction", "score")


def feature_importance(
    models: Mapping[int, PipelineModel | BoostedModel | ForestModel], spark, features: Sequence[str] = CORE_FEATURES
) -> DataFrame:
    """Importance of each feature averaged over the folds' tree models, largest first.

    Of boosted trees, the mean gain of a feature's splits as a share of all features'.
    """

    def shares(model) -> Sequence[float]:
        if isinstance(model, BoostedModel | ForestModel):
            own = model.importance()
            return [own[f] for f in features]
        return model.stages[-1].featureImportances.toArray()

    rows = [(held_out, f, float(x)) for held_out, model in models.items() for f, x in zip(features, shares(model), strict=True)]
    table = spark.createDataFrame(rows, "fold int, feature string, importance double")
    return table.groupBy("feature").agg(F.avg("importance").alias("importance")).orderBy(
        F.desc("importance"), "feature"
    )


def compare_models(
    table: FoldedTable, builders: Mapping[str, Builder], knn_k: int | None = 5, parallelism: int = 3
) -> DataFrame:
    """Out-of-fold scores of all models in one table, for the evaluation functions with ``by=["model"]``.

    The models are fitted at the same time: each runs many short jobs, between which the cores would wait for the driver.
    """
    fits = [partial(cross_validate, table, build, name, parallelism) for name, build in builders.items()]
    if knn_k:
        fits.append(partial(cross_validate_knn, table, knn_k, parallelism=parallelism))
    return _union(_in_threads(lambda fit: fit(), fits, parallelism, table.df.sparkSession))


def mean_auc_by_model(scored: DataFrame) -> DataFrame:
    """Models by mean fold AUC, best first."""
    return mean_fold_auc(scored, ["model"]).orderBy(F.desc("mean_fold_auc"), "model")


def fit_curve(
    table: FoldedTable,
    build: BoostedTrees,
    steps: int = 10,
    features: Sequence[str] = CORE_FEATURES,
    label: str = "ai_label",
    user_col: str = "user_id",
    fold: str = "fold",
    seed: int = 42,
    whole: bool = False,
) -> tuple[dict[tuple[int, int], BoostedModel], DataFrame]:
    """Boosted models of every fold and step, grown together, and their training rows.

    The last step's are the folds' models. With ``whole`` the model of the last step of fold -1 is the one
    trained on every row.
    """
    subsets = _subsets(table, steps, features, label, user_col, seed)
    rows, folds = subsets.select("label", *features, "held_out", "first_step"), sorted(table.fold_rows)
    if whole:
        every = table.df.select(F.col(label).alias("label"), *features, F.lit(-1).alias("held_out"), F.lit(steps).alias("first_step"))
        rows, folds = rows.unionByName(every), [-1, *folds]
    return build.fit_many(rows, features, folds, steps, table.n_rows), subsets


def _subsets(table: FoldedTable, steps: int, features: Sequence[str], label: str, user_col: str, seed: int) -> DataFrame:
    folds = len(table.fold_rows)
    rows = learning_subsets(table.df, steps, [user_col], seed, folds).select(
        user_col, F.col(label).alias("label"), *features, "held_out", "train_size", "first_step"
    )
    return cut_lineage(rows).coalesce(max(1, -(-table.n_rows * folds // ROWS_PER_PARTITION)))


def curve_scores(
    table: FoldedTable,
    models: Mapping[tuple[int, int], BoostedModel],
    subsets: DataFrame,
    features: Sequence[str] = CORE_FEATURES,
    label: str = "ai_label",
    fold: str = "fold",
) -> DataFrame:
    """Scores of every model on the rows it was trained on and on those of its fold, in one pass."""
    seen = subsets.select("label", *features, "held_out", "first_step", F.lit("train").alias("part"))
    unseen = table.df.select(
        F.col(label).alias("label"), *features, F.col(fold).alias("held_out"), F.lit(1).alias("first_step"), F.lit("held_out").alias("part")
    )
    return score_many(seen.unionByName(unseen), models, features)


def learning_curve(
    table: FoldedTable,
    build: Builder | BoostedTrees,
    steps: int = 10,
    features: Sequence[str] = CORE_FEATURES,
    label: str = "ai_label",
    user_col: str = "user_id",
    fold: str = "fold",
    seed: int = 42,
    parallelism: int = 3,
) -> DataFrame:
    """Mean AUC on training rows and on held-out rows for ``steps`` growing training sizes."""
    if isinstance(build, BoostedTrees):
        models, subsets = fit_curve(table, build, steps, features, label, user_col, fold, seed)
        return curve_areas(cut_lineage(curve_scores(table, models, subsets, features, label, fold)))
    folds = sorted(table.fold_rows)
    subsets = _subsets(table, steps, features, label, user_col, seed).withColumnRenamed("label", label)

    def fit(job: tuple[int, int]) -> DataFrame:
        held_out, step = job
        train_size = table.n_rows - table.fold_rows[held_out]
        rows = subsets.filter((F.col("held_out") == held_out) & (F.col("first_step") <= step))
        model = build(label, features, train_size * step // steps).fit(rows)
        seen = _scored(model, rows, user_col, label).withColumn("part", F.lit("train"))
        unseen = _scored(model, table.df.filter(F.col(fold) == held_out), user_col, label)
        return (
            seen.unionByName(unseen.withColumn("part", F.lit("held_out")))
            .withColumns({"step": F.lit(step), "fold": F.lit(held_out)})
        )

    jobs = [(f, s) for s in range(1, steps + 1) for f in folds]
    return curve_areas(cut_lineage(_union(_in_threads(fit, jobs, parallelism, table.df.sparkSession))))


def curve_areas(scored: DataFrame) -> DataFrame:
    """Training rows and mean areas of every step, from its scores."""
    areas = roc_auc(scored, ["step", "part", "fold"])
    per_fold = areas.groupBy("step", "fold").agg(
        F.max(F.when(F.col("part") == "train", F.col("n_pos") + F.col("n_neg"))).alias("n"),
        F.max(F.when(F.col("part") == "train", F.col("auc"))).alias("train_auc"),
        F.max(F.when(F.col("part") == "held_out", F.col("auc"))).alias("held_out_auc"),
    )
    return per_fold.groupBy("step").agg(
        F.min("n").alias("n_train"), F.avg("train_auc").alias("train_auc"), F.avg("held_out_auc").alias("cv_auc")
    )


def final_fit(
    table: FoldedTable, build: Builder | Together, features: Sequence[str] = CORE_FEATURES, label: str = "ai_label"
) -> Model:
    """The model trained on every row."""
    if _fits_together(build, features):
        rows = table.df.select(F.col(label).alias("label"), *features, F.lit(-1).alias("held_out"))
        return build.fit_together(rows, features, [-1], table.n_rows)[-1]
    return build(label, features, table.n_rows).fit(table.df)
