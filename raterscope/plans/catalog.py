"""Registered queries over the test tables: one per operator.

Doubles are rounded here, and only here, to make results comparable across engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import encode_id, label_name
from ..functions.text import clean_text
from ..operators import (
    activity,
    answers,
    classifiers,
    cleaning,
    dataset,
    distributions,
    evaluation,
    prompts,
    sampling,
    scoring,
    splits,
    statistics,
    validation,
)
from ..schemas import CORE_FEATURES, PLOT_FEATURES, STATISTICS
from ..session import cut_lineage
from ..sources import readers, views

Query = Callable[[SparkSession, str], DataFrame]

# Folds fitted at the same time: all, as their tables are small.
_FITS_AT_ONCE = 6
# Mean area under the curve that every model must reach on rows it has not seen.
_AUC_FLOOR = 0.9

_REGISTRY: dict[str, Query] = {}


def _query(function: Query) -> Query:
    _REGISTRY[function.__name__] = function
    return function


def queries() -> dict[str, Query]:
    """All registered queries by name."""
    return dict(_REGISTRY)


def _round(column: str):
    """Six digits; the small shift keeps exact halves from rounding apart, 0.0 removes minus zero."""
    return F.expr(f"round({column} + 1e-9D, 6) + 0D")


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: _round(c) for c in columns})


# --- shared inputs -------------------------------------------------------------------------


def _human_statistics(spark: SparkSession, folder: str) -> DataFrame:
    ratings = views.ratings_by_customer(spark, folder, titles=False)
    return statistics.user_statistics(ratings, levels=views.LEVELS, subset=["user_id", "rating"])


def _machine_statistics(spark: SparkSession, folder: str) -> DataFrame:
    ratings = views.ratings_by_event_user(spark, folder)
    return statistics.user_statistics(ratings, levels=views.LEVELS, subset=["user_id", "rating"])


def _labelled(spark: SparkSession, folder: str, n_human: int | None = None) -> DataFrame:
    human = _human_statistics(spark, folder)
    if n_human is not None:
        human = cut_lineage(human)  # sampling counts the table before it reads it
    both = dataset.labelled_dataset(human, _machine_statistics(spark, folder), n_human)
    return _rounded(both, *STATISTICS)


def _dataset(spark: SparkSession, folder: str) -> DataFrame:
    """The labelled table as training finds it: written once, then read."""
    return cut_lineage(_labelled(spark, folder))


def _balanced(spark: SparkSession, folder: str) -> DataFrame:
    return splits.balance_classes(_dataset(spark, folder))


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    """Closed-form scores, so that evaluation does not depend on a fitted model."""
    folded = splits.assign_folds(_dataset(spark, folder), seed=7)
    return folded.select(
        "fold",
        "user_id",
        F.col("ai_label").cast("double").alias("label"),
        F.col("kurtosis_rating").alias("score"),
        (F.col("kurtosis_rating") > -1).cast("double").alias("prediction"),
    )


def _table(spark: SparkSession, folder: str) -> validation.FoldedTable:
    return validation.prepare_folds(splits.balanced_folds(_dataset(spark, folder)))


def _builders():
    """The models at the size that training uses."""
    return classifiers.builders()


# --- sources, filters, projections ---------------------------------------------------------


@_query
def q_scan_parquet(spark, folder):
    orders = readers.read_dataset(spark, f"{folder}/orders.parquet")
    return orders.select("o_orderkey", "o_custkey", "o_orderpriority")


@_query
def q_output_summary(spark, folder):
    return activity.summarise_output(views.ratings_by_customer(spark, folder, titles=False))


@_query
def q_dropna_any(spark, folder):
    documents = views.table(spark, folder, "documents").select("doc_id", "lang")
    labels = views.table(spark, folder, "labels")
    return cleaning.drop_incomplete(documents.join(labels, "doc_id", "left"))


@_query
def q_encode_id(spark, folder):
    human = views.ratings_by_customer(spark, folder, titles=False).select("user_id").distinct()
    machine = views.ratings_by_event_user(spark, folder).select("user_id").distinct()
    parts = [
        df.select("user_id", encode_id("user_id", label).alias("encoded_id"), F.lit(label).alias("ai_label"))
        for df, label in ((human, 0), (machine, 1))
    ]
    return parts[0].unionByName(parts[1])


@_query
def q_target_user(spark, folder):
    return cleaning.only_user(views.ratings_by_event_user(spark, folder), "user_id", "42")


@_query
def q_clean_text(spark, folder):
    return views.table(spark, folder, "documents").select(
        "doc_id", F.md5(clean_text("text")).alias("text_md5"), F.length(clean_text("text")).cast("bigint").alias("n_chars")
    )


@_query
def q_label_name(spark, folder):
    documents = views.table(spark, folder, "documents").select("doc_id")
    labels = views.table(spark, folder, "labels")
    return documents.join(labels, "doc_id", "left").select("doc_id", label_name("quality").alias("label_name"))


@_query
def q_distinct_values(spark, folder):
    return activity.distinct_values(views.table(spark, folder, "events"), "event_type")


# --- activity and sampling -----------------------------------------------------------------


@_query
def q_qualified_users(spark, folder):
    return activity.qualified_users(views.ratings_by_supplier(spark, folder), 600)


@_query
def q_qualified_ratings(spark, folder):
    return activity.qualified_ratings(views.ratings_by_supplier(spark, folder), 600)


@_query
def q_distinct_users(spark, folder):
    return activity.distinct_users(views.ratings_by_customer(spark, folder, titles=False))


@_query
def q_sample_k(spark, folder):
    return sampling.sample_per_user(
        views.ratings_by_supplier(spark, folder), 300, ["movie_id"], min_count=600
    )


@_query
def q_sample_about(spark, folder):
    human = cut_lineage(_human_statistics(spark, folder))
    return sampling.sample_about(human, 1000, ["user_id"]).select("user_id")


@_query
def q_sample_users(spark, folder):
    return sampling.sample_users(views.ratings_by_customer(spark, folder, titles=False), 100)


@_query
def q_assign_temperature(spark, folder):
    users = views.ratings_by_customer(spark, folder, titles=False).select("user_id").distinct()
    return sampling.assign_choice(users)


# --- requests and answers ------------------------------------------------------------------


@_query
def q_requests(spark, folder):
    ratings = views.ratings_by_customer(spark, folder)
    return prompts.request_lines(prompts.build_requests(prompts.sample_requests(ratings, 100)))


@_query
def q_json_valid(spark, folder):
    return answers.with_validity(views.answers(spark, folder)).select("movie_id", "is_valid")


@_query
def q_quarantine(spark, folder):
    return answers.split_valid_json(views.answers(spark, folder))[1]


@_query
def q_rejected_ids(spark, folder):
    users = views.ratings_by_customer(spark, folder, titles=False).select("user_id").distinct()
    text = F.col("user_id").cast("string")
    odd = F.when(F.col("user_id") % 7 == 0, F.concat(text, F.lit(".0"))).otherwise(text)
    return dataset.rejected_ids(users.select(odd.alias("user_id")), 0)


@_query
def q_user_stats_wide(spark, folder):
    """A declared scale with one level far from the others."""
    lines = views.table(spark, folder, "lineitem")
    far = F.when((F.col("l_suppkey") % 3 == 0) & (F.col("l_partkey") % 5 == 0), 1_000_000.0).otherwise(0.0)
    ratings = lines.select(
        F.col("l_suppkey").alias("user_id"), (F.col("l_linenumber").cast("double") + far).alias("rating")
    )
    levels = [base + n for base in (0.0, 1_000_000.0) for n in range(1, 8)]
    return _rounded(statistics.user_statistics(ratings, levels=levels), *STATISTICS)


@_query
def q_parse_responses(spark, folder):
    return answers.parse_answers(views.answers(spark, folder))


@_query
def q_parse_audit(spark, folder):
    audited = answers.audit_answers(views.answers(spark, folder), min_rating=1, max_rating=4)
    return answers.audit_counts(audited)


# --- statistics ----------------------------------------------------------------------------


@_query
def q_user_stats(spark, folder):
    ratings = views.ratings_by_supplier(spark, folder)
    return _rounded(statistics.user_statistics(ratings, levels=views.LEVELS), *STATISTICS)


@_query
def q_user_stats_deliveries(spark, folder):
    """Statistics from the level counts of two deliveries, each counted by itself."""
    ratings = views.ratings_by_supplier(spark, folder)
    halves = [ratings.filter(F.pmod(F.xxhash64("movie_id"), F.lit(2)) == i) for i in (0, 1)]
    counts = [statistics.level_counts(half, views.LEVELS) for half in halves]
    found = statistics.statistics_of_counts(statistics.add_counts(counts), views.LEVELS)
    return _rounded(found, *STATISTICS)


@_query
def q_user_stats_general(spark, folder):
    ratings = views.ratings_by_customer(spark, folder, titles=False)
    return _rounded(statistics.user_statistics(ratings), *STATISTICS)


@_query
def q_user_stats_core(spark, folder):
    ratings = views.ratings_by_customer(spark, folder, titles=False)
    stats = statistics.user_statistics(
        ratings, features=CORE_FEATURES, levels=views.LEVELS, subset=["user_id", "rating"]
    )
    return _rounded(stats, *CORE_FEATURES)


@_query
def q_rating_hist(spark, folder):
    return _rounded(statistics.rating_histogram(views.ratings_by_supplier(spark, folder)), "share")


@_query
def q_mode(spark, folder):
    return statistics.user_mode(views.ratings_by_customer(spark, folder, titles=False))


@_query
def q_mode_window(spark, folder):
    return statistics.tied_modes(views.ratings_by_customer(spark, folder, titles=False))


@_query
def q_entropy(spark, folder):
    ratings = views.ratings_by_customer(spark, folder, titles=False)
    return _rounded(statistics.user_entropy(ratings), "entropy_rating")


# --- labelled dataset ----------------------------------------------------------------------


@_query
def q_ml_dataset(spark, folder):
    return _labelled(spark, folder, 1000)


@_query
def q_balance(spark, folder):
    return _balanced(spark, folder).select("user_id", "ai_label")


@_query
def q_folds(spark, folder):
    return splits.balanced_folds(_dataset(spark, folder)).select("user_id", "ai_label", "fold")


@_query
def q_class_means(spark, folder):
    return _rounded(dataset.class_means(_balanced(spark, folder)), *CORE_FEATURES)


@_query
def q_class_counts(spark, folder):
    return dataset.class_counts(_balanced(spark, folder))


@_query
def q_vif(spark, folder):
    return _rounded(dataset.variance_inflation(_labelled(spark, folder)), "vif")


@_query
def q_correlation(spark, folder):
    return _rounded(dataset.correlation_pairs(_labelled(spark, folder)), "corr")


@_query
def q_learning_subsets(spark, folder):
    folded = splits.balanced_folds(_dataset(spark, folder)).select("user_id", "ai_label", "fold")
    return splits.learning_subsets(folded)


# --- distributions -------------------------------------------------------------------------


@_query
def q_int_hist(spark, folder):
    return distributions.integer_histogram(views.ratings_by_customer(spark, folder, titles=False))


@_query
def q_first_user_hist(spark, folder):
    ratings = views.ratings_by_customer(spark, folder, titles=False)
    as_text = ratings.select(*[F.col(c).cast("string").alias(c) for c in ("user_id", "rating")])
    return distributions.first_user_histogram(scoring.as_upload(as_text, "user_id", "rating")[0])


@_query
def q_feature_hist(spark, folder):
    counted = distributions.feature_histogram(_dataset(spark, folder), PLOT_FEATURES)
    return _rounded(counted, "bin_start", "bin_end")


@_query
def q_kde(spark, folder):
    return _rounded(distributions.feature_density(_dataset(spark, folder)), "x", "density", "scaled")


# --- evaluation ----------------------------------------------------------------------------


@_query
def q_auc(spark, folder):
    return _rounded(evaluation.roc_auc(_scored(spark, folder)), "auc")


@_query
def q_mean_auc(spark, folder):
    scored = cut_lineage(_scored(spark, folder))
    per_fold = evaluation.mean_fold_auc(scored)
    pooled = evaluation.pooled_auc(scored)
    rows = [
        df.select(F.lit(name).alias("metric"), _round(name).alias("auc"))
        for df, name in ((per_fold, "mean_fold_auc"), (pooled, "pooled_auc"))
    ]
    return rows[0].unionByName(rows[1])


@_query
def q_roc(spark, folder):
    return _rounded(evaluation.roc_points(_scored(spark, folder)), "fpr", "tpr")


@_query
def q_confusion(spark, folder):
    return evaluation.confusion_matrix(_scored(spark, folder))


@_query
def q_fold_report(spark, folder):
    return _rounded(evaluation.average_report(_scored(spark, folder)), "precision", "recall", "f1")


# --- scoring tables ------------------------------------------------------------------------


@_query
def q_score_stats(spark, folder):
    features = statistics.core_features(views.ratings_by_customer(spark, folder, titles=False))
    shown = scoring.score_stats(features)
    return _rounded(shown, "SD", "Skewness", "Kurtosis")


@_query
def q_score_combined(spark, folder):
    combined = statistics.combined_features(views.ratings_by_event_user(spark, folder))
    return _rounded(scoring.with_status(combined, scoring.NO_VALID_RATINGS), *CORE_FEATURES)


# --- models --------------------------------------------------------------------------------


@_query
def q_knn(spark, folder):
    table = validation.prepare_folds(splits.assign_folds(_dataset(spark, folder), seed=7))
    scored = validation.cross_validate_knn(table, parallelism=_FITS_AT_ONCE)
    return _rounded(scored.select("fold", "user_id", "prediction", "score"), "score")


def _checked(scored: DataFrame) -> DataFrame:
    """Out-of-fold rows with what must hold of every score.

    ``agrees``: the prediction is the side of a half on which the score lies. ``bounded``: the score is a
    probability. The fitted values themselves have no SQL form; ``tests`` checks them against plain versions.
    """
    score = F.col("score")
    agrees = F.col("prediction") == (score > 0.5).cast("double")
    return scored.select("model", "fold", "user_id", "label", agrees.alias("agrees"), score.between(0.0, 1.0).alias("bounded"))


def _one_model(spark, folder, name):
    return _checked(validation.cross_validate(_table(spark, folder), _builders()[name], name, _FITS_AT_ONCE))


@_query
def q_gbt_oof(spark, folder):
    """Probabilities of the boosted trees. No SQL form; ``tests/test_boosting.py`` has a plain version."""
    scored = validation.cross_validate(_table(spark, folder), _builders()["boosted_trees"], "boosted_trees")
    return scored.select("model", "fold", "user_id", "label", "prediction", "score")


@_query
def q_rf_oof(spark, folder):
    return _one_model(spark, folder, "random_forest")


@_query
def q_svm_oof(spark, folder):
    return _one_model(spark, folder, "support_vectors")


@_query
def q_lr_oof(spark, folder):
    return _one_model(spark, folder, "logistic_regression")


@_query
def q_oof(spark, folder):
    table, chosen = _table(spark, folder), _builders()
    parts = [
        validation.cross_validate(table, chosen[name], name, _FITS_AT_ONCE)
        for name in ("random_forest", "logistic_regression")
    ]
    return _checked(parts[0].unionByName(parts[1]))


@_query
def q_importance(spark, folder):
    """Share of each feature in the mean gain of splits, largest first. No SQL form, as above."""
    models = validation.fit_folds(_table(spark, folder), _builders()["boosted_trees"])
    return validation.feature_importance(models, spark)


@_query
def q_model_compare(spark, folder):
    """All five models, each far better than chance on rows it has not seen."""
    scored = validation.compare_models(_table(spark, folder), _builders(), parallelism=_FITS_AT_ONCE)
    areas = validation.mean_auc_by_model(cut_lineage(scored))
    return areas.select("model", F.col("mean_fold_auc").between(_AUC_FLOOR, 1.0).alias("above_floor"))


@_query
def q_learning_curve(spark, folder):
    """Every step's training rows, and areas that are areas."""
    curve = validation.learning_curve(
        _table(spark, folder), _builders()["boosted_trees"], parallelism=_FITS_AT_ONCE
    )
    bounded = F.col("train_auc").between(_AUC_FLOOR, 1.0) & F.col("cv_auc").between(0.0, 1.0)
    return curve.select("step", "n_train", bounded.alias("bounded"))


@_query
def q_score(spark, folder):
    """Every rater, its status, and a class that agrees with the probability."""
    model = validation.final_fit(_table(spark, folder), _builders()["boosted_trees"])
    ratings = views.ratings_by_customer(spark, folder, titles=False)
    predictions, _ = scoring.score_raters(model, ratings, "user_id", "rating")
    probability = F.col("Probability AI")
    agrees = F.col("Prediction") == F.when(probability > 0.5, "AI").otherwise("Human")
    return predictions.select(
        "user_id", "status", agrees.alias("agrees"), probability.between(0.0, 1.0).alias("bounded")
    )
