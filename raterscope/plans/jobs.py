"""The stages from file to file. Each reads paths, writes paths and returns what it wrote."""

from __future__ import annotations

import logging
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

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
from ..schemas import PLOT_FEATURES, RATINGS, STATISTICS, SYNTHETIC_RATINGS
from ..session import cut_lineage, intermediate_tables
from ..sources import models, readers, writers

_LOG = logging.getLogger(__name__)


def _ratings(spark: SparkSession, path: str, rejects: str | None, schema=RATINGS, multi_line: bool = False) -> DataFrame:
    """Ratings whose cells all fit. The other lines are counted, and written below ``rejects`` if it is named."""
    raw = readers.read_ratings_csv(spark, path, schema, keep_corrupt=True, multi_line=multi_line)
    good, bad = readers.split_corrupt(cut_lineage(raw))
    n = bad.count()
    if n:
        _LOG.warning("%d lines of %s do not fit the schema", n, path)
    if rejects is not None:
        writers.write_parquet(bad, rejects)
    return good


def qualify(
    spark: SparkSession,
    ratings_path: str,
    out: str,
    k: int = 300,
    min_count: int = 300,
    seed: int = 42,
    rejects: str | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """Sample ``k`` ratings of each rater with at least ``min_count``; returns rows and users written.

    Lines that do not fit the schema are counted and, with ``rejects``, kept there. ``multi_line`` reads titles
    with line breaks; in the output a break is a space, so that later stages need not.
    """
    with intermediate_tables(spark):
        ratings = _ratings(spark, ratings_path, rejects, multi_line=multi_line)
        writers.write_csv(sampling.sample_per_user(ratings, k, ["movie_id"], seed, min_count), out, keep_breaks=False)
    return activity.summarise_output(readers.read_ratings_csv(spark, out))


def request_file(
    spark: SparkSession,
    ratings_path: str,
    out: str,
    n_users: int = 4000,
    seed: int = 42,
    rejects: str | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """Write the model requests for ``n_users`` random raters; raises if there are fewer.

    Each run writes its own folder below ``out``, named by the time. Lines that do not fit the schema are
    counted and, with ``rejects``, kept there. Returns the lines written.
    """
    path = f"{out.rstrip('/')}/requests_{writers.run_id()}"
    with intermediate_tables(spark):
        ratings = _ratings(spark, ratings_path, rejects, multi_line=multi_line)
        sampling.require_users(ratings, n_users)
        requests = prompts.build_requests(prompts.sample_requests(ratings, n_users, seed=seed))
        writers.write_ndjson(prompts.request_lines(requests), path)
    return readers.read_ndjson(spark, path)


def answer_file(
    spark: SparkSession,
    prefix: str,
    out: str,
    audit_out: str,
    min_rating: float | None = None,
    max_rating: float | None = None,
) -> DataFrame:
    """Parse all answer files under a prefix to ratings; returns the line count of each status.

    Without any answers nothing is written and the counts are empty. The audited lines are written first, and both the ratings and the counts come from that
    table, so the answers are parsed once. It holds the raw line and its file of every answer
    that gave no rating.
    """
    lines = readers.read_ndjson(spark, prefix)
    if lines.isEmpty():
        _LOG.warning("no answers under %s", prefix)
        return answers.audit_counts(answers.audit_answers(lines))
    writers.write_parquet(answers.audit_answers(lines, "value", min_rating, max_rating), audit_out)
    audited = readers.read_dataset(spark, audit_out)
    rated = audited.filter(F.col("status") == answers.OK)
    writers.write_csv(rated.select(*SYNTHETIC_RATINGS.names), out, keep_breaks=False)
    return answers.audit_counts(audited)


def statistics_table(
    spark: SparkSession,
    ratings_path: str,
    out: str,
    features: Sequence[str] = STATISTICS,
    levels: Sequence[float] | str | None = None,
    synthetic: bool = False,
    rejects: str | None = None,
) -> DataFrame:
    """Rater statistics of one ratings table; returns rows and users written.

    ``levels`` names the rating scale for the one-shuffle plan, ``"discover"`` looks for it first. Lines that
    do not fit the schema are counted and, with ``rejects``, kept there.
    """
    schema = SYNTHETIC_RATINGS if synthetic else RATINGS
    with intermediate_tables(spark):
        ratings = _ratings(spark, ratings_path, rejects, schema)
        writers.write_csv(statistics.user_statistics(ratings, features=features, levels=levels), out)
    return activity.summarise_output(readers.read_upload_csv(spark, out))


def add_delivery(
    spark: SparkSession,
    ratings_path: str,
    state: str,
    delivery: str,
    levels: Sequence[float] = (1, 2, 3, 4, 5),
    synthetic: bool = False,
    rejects: str | None = None,
) -> DataFrame:
    """Add one more ratings file to a folder of level counts; returns raters and ratings of the delivery.

    Only the new file is read. Its counts are written aside and then renamed to ``delivery=<name>``, in one step of the file
    system: a run that ends before leaves nothing that a reader sees, and is repeated. A delivery that is there already is
    not counted again. The scale is kept beside the counts, and another one is refused.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path
    place = path(f"{state.rstrip('/')}/delivery={delivery}")
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(place):
        with intermediate_tables(spark):
            ratings = _ratings(spark, ratings_path, rejects, SYNTHETIC_RATINGS if synthetic else RATINGS)
            counted = statistics.level_counts(ratings, levels).withColumn("levels", F.array(*[F.lit(float(v)) for v in sorted(levels)]))
            aside = f"{state.rstrip('/')}/_adding-{uuid.uuid4().hex}"
            writers.write_parquet(counted, aside)
        if not files.rename(path(aside), place):
            files.delete(path(aside), True)
            if not files.exists(place):
                raise OSError(f"{aside} could not be renamed to {place}")
    else:
        _LOG.warning("delivery %s is counted already", delivery)
    added = spark.read.parquet(place.toString())
    return added.agg(F.count(F.lit(1)).alias("n_users"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"))


def delivered_statistics(
    spark: SparkSession,
    state: str,
    out: str,
    levels: Sequence[float] = (1, 2, 3, 4, 5),
    features: Sequence[str] = STATISTICS,
) -> DataFrame:
    """Rater statistics of all deliveries in a folder of ``add_delivery``; returns rows and users written. Reads counts, no ratings."""
    counted = spark.read.parquet(state)
    scale = [float(v) for v in sorted(levels)]
    others = counted.select("levels").distinct().limit(2).collect()
    if any(list(row["levels"]) != scale for row in others):
        raise ValueError(f"the deliveries were counted on another scale than {scale}")
    names = ["user_id", "_n", *[f"_n{i}" for i in range(len(scale))]]
    found = statistics.statistics_of_counts(statistics.add_counts([counted.select(*names)]), scale, features)
    writers.write_csv(found, out)
    return activity.summarise_output(readers.read_upload_csv(spark, out))


def labelled_table(
    spark: SparkSession,
    human_path: str,
    machine_path: str,
    out: str,
    n_human: int | None = 4000,
    seed: int = 42,
    codec: str = "uncompressed",
    features: Sequence[str] = STATISTICS,
    rejects: str | None = None,
) -> DataFrame:
    """Join both statistics tables to the labelled dataset; returns class counts.

    Rows whose id cannot carry the label, or with a cell that is there but is no number, are left out, counted and,
    with ``rejects``, kept there as text: with their label and the reason. An empty cell is an undefined statistic and stays.
    """
    with intermediate_tables(spark):
        good, bad = [], []
        for label, path in enumerate((human_path, machine_path)):
            raw = cut_lineage(readers.read_stats_text(spark, path, features))
            fitting, broken = readers.split_broken_cells(raw)
            good.append(fitting)
            lost = dataset.rejected_rows(fitting, label).select(*[F.col(c).cast("string") for c in raw.columns])
            reasons = ((broken, "no_number"), (lost, "id_too_long"))
            bad += [rows.select(*raw.columns, F.lit(label).alias("ai_label"), F.lit(why).alias("reason")) for rows, why in reasons]
        left_out = cut_lineage(reduce(DataFrame.unionByName, bad))
        for row in left_out.groupBy("reason").count().collect():
            _LOG.warning("%d raters left out: %s", row["count"], row["reason"])
        if rejects is not None:
            writers.write_parquet(left_out, rejects)
        both = dataset.labelled_dataset(*good, n_human, seed, features)
        writers.write_parquet(both, out, codec)
    return dataset.class_counts(readers.read_dataset(spark, out))


def train(
    spark: SparkSession,
    dataset_path: str,
    out: str,
    models_folder: str,
    rounds: int = 100,
    trees: int = 100,
    svm_iterations: int = 20,
    folds: int = 6,
    seed: int = 42,
    curve_steps: int = 10,
) -> str:
    """Balance, cross-validate, compare, evaluate and fit the final model; returns its path.

    Every table a report needs is written below ``out``.
    """
    with intermediate_tables(spark):
        raw = readers.read_dataset(spark, dataset_path)
        writers.write_parquet(splits.balanced_folds(raw, k=folds, seed=seed), f"{out}/balanced")
        balanced = readers.read_dataset(spark, f"{out}/balanced")
        table = validation.prepare_folds(balanced)
        chosen = classifiers.builders(rounds, trees, svm_iterations)

        # Folds, steps of the curve and the final model grow together.
        steps = max(curve_steps, 1)
        grown, subsets = validation.fit_curve(table, chosen["boosted_trees"], steps, seed=seed, whole=True)
        final = grown.pop((-1, steps))
        grown = {key: model for key, model in grown.items() if key[0] >= 0}
        fitted = {fold: model for (fold, step), model in grown.items() if step == steps}
        others = {name: build for name, build in chosen.items() if name != "boosted_trees"}
        scored = validation.out_of_fold(table, fitted, "boosted_trees").unionByName(
            validation.compare_models(table, others)
        )
        writers.write_parquet(scored, f"{out}/out_of_fold")
        scored = readers.read_dataset(spark, f"{out}/out_of_fold")
        plotted = [f for f in PLOT_FEATURES if f in balanced.columns]
        reports = {
            "class_counts": dataset.class_counts(balanced),
            "class_means": dataset.class_means(balanced),
            "variance_inflation": dataset.variance_inflation(balanced),
            "feature_histograms": distributions.feature_histogram(balanced, plotted),
            "feature_densities": distributions.feature_density(balanced, plotted),
            "importance": validation.feature_importance(fitted, spark),
            "report": evaluation.average_report(scored, ["model"]),
            "confusion": evaluation.confusion_matrix(scored, ["model"]),
            "auc_by_fold": evaluation.roc_auc(scored, ["model", "fold"]),
            "auc_pooled": evaluation.pooled_auc(scored, ["model"]),
            "auc_mean": validation.mean_auc_by_model(scored),
            "roc": evaluation.roc_points(scored, ["model"]),
            "splits": final.ledger(spark).filter("feature is not null"),
        }
        if curve_steps:
            curve = cut_lineage(validation.curve_scores(table, grown, subsets))
            reports["learning_curve"] = validation.curve_areas(curve)
        for name, report in reports.items():
            writers.write_parquet(report, f"{out}/{name}")
    return models.save_model(final, models_folder)


def score(
    spark: SparkSession,
    model_path: str,
    ratings_path: str,
    out: str,
    user_col: str | None = None,
    rating_col: str | None = None,
    target_user: object = None,
    combine_all: bool = False,
) -> DataFrame:
    """Score an uploaded ratings table; returns the predictions written.

    With ``combine_all`` all ratings count as one rater and ``target_user`` is ignored.
    """
    model = models.load_model(model_path)
    with intermediate_tables(spark):
        ratings = readers.read_upload_csv(spark, ratings_path)
        if combine_all:
            predictions, stats = scoring.score_combined(model, ratings, user_col, rating_col)
        else:
            predictions, stats = scoring.score_raters(model, ratings, user_col, rating_col, target_user)
        renamed = predictions.withColumnRenamed("Probability AI", "Probability_AI")
        writers.write_parquet(renamed, f"{out}/predictions")
        writers.write_parquet(stats, f"{out}/statistics")
        histogram = _rating_distribution(ratings, user_col, rating_col, target_user, combine_all)
        writers.write_parquet(histogram, f"{out}/distribution")
    return readers.read_dataset(spark, f"{out}/predictions")


def _rating_distribution(ratings, user_col, rating_col, target_user, combine_all) -> DataFrame:
    rated, _ = scoring.as_upload(ratings, user_col, rating_col)
    if combine_all:
        return distributions.integer_histogram(rated)
    if target_user is not None:
        rated = cleaning.only_user(rated, "user_id", target_user)
    return distributions.first_user_histogram(rated)
