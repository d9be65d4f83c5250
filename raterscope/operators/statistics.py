"""Per-rater statistics of ratings.

Two plans give the same table:

* **levels** - ratings come from a known scale (1 to 5, half steps, ...). One hash aggregation
  counts every level per rater, and all ten statistics are arithmetic on those counts. One scan,
  one shuffle of one fixed-width row per rater and map task, no sort, no window.
* **general** - ratings may be any number. Moments come from Spark's aggregates, whose partial states
  are a few numbers; quantiles from sketches that are merged by rater and salt and then by rater; mode and entropy
  from a ``(rater, rating)`` histogram that is hashed on both columns and then aggregated again. Three scans.

Neither gathers the ratings of one rater in one task, so a rater with a third of all rows is
spread over the whole cluster in both.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import CORE_FEATURES, STATISTICS
from ..session import cut_lineage
from .cleaning import drop_incomplete, is_number, require_columns

MAX_LEVELS = 64
_GLANCE_ROWS = 10_000
QUARTILES = (0.25, 0.5, 0.75)
# Ratings that a sketch holds as they are, and sketches that are merged last for one rater.
SKETCH_SIZE = 4096
SKETCH_SALTS = 16
# Statistics taken from the histogram in the general plan.
_HISTOGRAM_STATISTICS = ("mode_rating", "entropy_rating")


def discover_levels(df: DataFrame, rating_col: str = "rating", max_levels: int = MAX_LEVELS) -> list[float] | None:
    """The sorted rating scale if it has at most ``max_levels`` finite values, else None. Runs two jobs.

    A glance at some rows tells most continuous columns apart before the whole table is grouped.
    Only ``max_levels + 1`` values can reach the driver.
    """
    rated = df.select(F.col(rating_col).cast("double").alias("level")).filter(is_number("level"))
    if rated.limit(_GLANCE_ROWS).distinct().count() > max_levels:
        return None
    found = [row["level"] for row in rated.distinct().limit(max_levels + 1).collect()]
    return sorted(found) if len(found) <= max_levels and all(map(math.isfinite, found)) else None


def user_statistics(
    df: DataFrame,
    user_col: str = "user_id",
    rating_col: str = "rating",
    features: Sequence[str] = STATISTICS,
    levels: Sequence[float] | str | None = None,
    subset: Sequence[str] | None = None,
    drop_undefined: bool = True,
) -> DataFrame:
    """One row per rater: mean, median, mode, sd, extremes, IQR, kurtosis, skewness, entropy.

    Kurtosis (excess) and skewness are population forms, sd has n-1, quantiles are observed
    values, the mode is the smallest of tied ratings, entropy is in nats.

    ``levels`` names the rating scale and selects the levels plan; a rating off the scale stops
    the job rather than being lost. ``"discover"`` looks for a scale first. Rows with a null in
    any column are left out (``subset`` narrows that test and lets the scan read fewer columns; rows
    without a rater or rating are left out in any case), and so are raters for whom a chosen statistic is undefined, unless ``drop_undefined=False``.
    """
    require_columns(df, [user_col, rating_col])
    unknown = [f for f in features if f not in STATISTICS]
    if unknown:
        raise ValueError(f"unknown statistics: {unknown}")
    if levels == "discover":
        levels = discover_levels(df, rating_col)
    clean = _rated(drop_incomplete(df, subset), user_col, rating_col)
    if levels:
        return statistics_of_counts(_counted(clean, user_col, _scale(levels)), levels, features, user_col, drop_undefined)
    stats = _from_values(clean, user_col, features)
    return stats.dropna("any") if drop_undefined else stats


def _scale(levels: Sequence[float]) -> list[float]:
    if not all(math.isfinite(v) for v in levels):
        raise ValueError("levels must be finite")
    return sorted(float(v) for v in levels)


def _count_names(levels: Sequence[float]) -> list[str]:
    return [f"_n{i}" for i in range(len(levels))]


def _counted(clean: DataFrame, user_col: str, levels: list[float]) -> DataFrame:
    """``_n`` and the number of each level for every rater; a rating off the scale stops the job."""
    counts = _count_names(levels)
    grouped = clean.groupBy(user_col).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.expr(f"count_if(_rating = {v!r}D) AS {c}") for v, c in zip(levels, counts)],
    )
    off_scale = f"raise_error('rating outside the declared levels {levels}')"
    return grouped.filter(f"CASE WHEN {' + '.join(counts)} = _n THEN true ELSE {off_scale} END")


def level_counts(
    df: DataFrame,
    levels: Sequence[float],
    user_col: str = "user_id",
    rating_col: str = "rating",
    subset: Sequence[str] | None = None,
) -> DataFrame:
    """What all statistics of a rater follow from, and what adds up over deliveries: its ratings on each level.

    One narrow row for each rater, however many ratings it has: ``_n`` and ``_n0``, ``_n1``, ... by ascending level.
    """
    require_columns(df, [user_col, rating_col])
    return _counted(_rated(drop_incomplete(df, subset), user_col, rating_col), user_col, _scale(levels))


def add_counts(tables: Sequence[DataFrame], user_col: str = "user_id") -> DataFrame:
    """The level counts of several deliveries as those of all their ratings."""
    every = reduce(DataFrame.unionByName, tables)
    return every.groupBy(user_col).agg(*[F.sum(c).alias(c) for c in every.columns if c != user_col])


def statistics_of_counts(
    counted: DataFrame,
    levels: Sequence[float],
    features: Sequence[str] = STATISTICS,
    user_col: str = "user_id",
    drop_undefined: bool = True,
) -> DataFrame:
    """Statistics from level counts alone.

    Central moments are sums over the levels about the rater's own mean, so they lose nothing on a
    wide scale, and only whole numbers are shuffled. Undefined raters are recognised by their
    counts: a filter on the finished formulas would be pushed below them and repeat them.
    """
    levels = _scale(levels)
    values, counts, checked = [f"{v!r}D" for v in levels], _count_names(levels), counted
    largest = f"greatest({', '.join(counts)})" if len(counts) > 1 else counts[0]
    varied = f"{largest} < _n"
    if drop_undefined and {"kurtosis_rating", "skewness_rating"} & set(features):
        checked = checked.filter(varied)
    elif drop_undefined and "sd_rating" in features:
        checked = checked.filter("_n > 1")
    pairs = list(zip(counts, values))
    # The mean is taken about a level that the rater has, so that small steps far from zero stay exact.
    anchor = f"CASE {' '.join(f'WHEN {c} > 0 THEN {v}' for c, v in pairs)} END"
    checked = checked.withColumn("_anchor", F.expr(anchor))
    apart = " + ".join(f"{c} * ({v} - _anchor)" for c, v in pairs)
    checked = checked.withColumn("_shift", F.expr(f"({apart}) / _n"))

    def moment(k: int) -> str:
        return "(" + " + ".join(f"{c} * {' * '.join([f'(({v} - _anchor) - _shift)'] * k)}" for c, v in pairs) + ") / _n"

    wanted = {2: "sd_rating kurtosis_rating skewness_rating", 3: "skewness_rating", 4: "kurtosis_rating"}
    for k, users in wanted.items():
        if set(users.split()) & set(features):
            checked = checked.withColumn(f"_m{k}", F.expr(moment(k)))

    def first_level(tests: Sequence[str]) -> str:
        return f"CASE {' '.join(f'WHEN {t} THEN {v}' for t, v in tests)} END"

    def quantile(p: float) -> str:
        running = [" + ".join(counts[: i + 1]) for i in range(len(counts))]
        return first_level([(f"{r} >= _n * {p}D", v) for r, v in zip(running, values)])

    p_ln_p = " + ".join(f"if({c} > 0, {c} / _n * ln({c} / _n), 0D)" for c in counts)
    formulas = {
        "mean_rating": "_anchor + _shift",
        "median_rating": quantile(0.5),
        "mode_rating": first_level([(f"{c} = {largest}", v) for c, v in pairs]),
        "sd_rating": f"CASE WHEN {varied} THEN sqrt(_m2 * (_n / (_n - 1D))) WHEN _n > 1 THEN 0D END",
        "max_rating": first_level([(f"{c} > 0", v) for c, v in reversed(pairs)]),
        "min_rating": first_level([(f"{c} > 0", v) for c, v in pairs]),
        "iqr_rating": f"{quantile(0.75)} - {quantile(0.25)}",
        "kurtosis_rating": f"CASE WHEN {varied} THEN try_divide(try_divide(_m4, _m2), _m2) - 3D END",
        "skewness_rating": f"CASE WHEN {varied} THEN try_divide(try_divide(_m3, _m2), sqrt(_m2)) END",
        "entropy_rating": f"0D - ({p_ln_p})",
    }
    return checked.select(user_col, *[F.expr(f"{formulas[f]} AS {f}") for f in features])


def _moments(features: Sequence[str]) -> list[Column]:
    rating = F.col("_rating")
    formulas = {
        "mean_rating": F.avg(rating),
        "sd_rating": F.stddev_samp(rating),
        "max_rating": F.max(rating),
        "min_rating": F.min(rating),
        "kurtosis_rating": F.kurtosis(rating),
        "skewness_rating": F.skewness(rating),
    }
    return [formulas[f].alias(f) for f in features if f in formulas]


def _from_values(clean: DataFrame, user_col: str, features: Sequence[str]) -> DataFrame:
    aggregates = _moments(features)
    from_histogram = [f for f in features if f in _HISTOGRAM_STATISTICS]
    parts = []
    if aggregates:
        parts.append(clean.groupBy(user_col).agg(*aggregates))
    if {"median_rating", "iqr_rating"} & set(features):
        parts.append(merged_quantiles(quantile_sketches(clean, user_col), user_col))
    if from_histogram:
        parts.append(_mode_and_entropy(_histogram(clean, user_col), user_col).select(user_col, *from_histogram))
    stats = reduce(lambda a, b: a.join(b, user_col), parts)
    if "_quartiles" in stats.columns:
        low, middle, high = (F.element_at("_quartiles", i) for i in (1, 2, 3))
        stats = stats.withColumns({"median_rating": middle, "iqr_rating": high - low})
    return stats.select(user_col, *features)


def quantile_sketches(clean: DataFrame, user_col: str, rating_col: str = "_rating", size: int = SKETCH_SIZE) -> DataFrame:
    """Sketches of every rater's ratings, at most ``SKETCH_SALTS`` of them a rater: ``_sketch``, which can be kept and merged.

    Tasks sketch what they read; those of one rater and salt are merged in one task. A rater met by a thousand tasks is
    so spread over all salts, and no task merges more than its share of sketches.
    """
    salted = clean.withColumn("_salt", F.spark_partition_id() % SKETCH_SALTS)
    sketch = F.kll_sketch_agg_double(F.col(rating_col), F.lit(size)).alias("_sketch")
    return salted.groupBy(user_col, "_salt").agg(sketch).select(user_col, "_sketch")


def merged_quantiles(sketches: DataFrame, user_col: str, size: int = SKETCH_SIZE) -> DataFrame:
    """``_quartiles`` of each rater from all its sketches, of one or several deliveries.

    Observed values. They are exact for up to ``size`` ratings; beyond, their rank is off by a small part of a percent.
    """
    merged = sketches.groupBy(user_col).agg(F.kll_merge_agg_double(F.col("_sketch"), F.lit(size)).alias("_all"))
    fractions = F.array(*[F.lit(q) for q in QUARTILES])
    return merged.select(user_col, F.kll_sketch_get_quantile_double("_all", fractions).alias("_quartiles"))


def _histogram(clean: DataFrame, user_col: str) -> DataFrame:
    return clean.groupBy(user_col, "_rating").agg(F.count(F.lit(1)).alias("_count"))


def _mode_and_entropy(histogram: DataFrame, user_col: str) -> DataFrame:
    count = F.col("_count")
    summed = histogram.groupBy(user_col).agg(
        F.max_by("_rating", F.struct("_count", -F.col("_rating"))).alias("mode_rating"),
        F.sum("_count").alias("_n"),
        F.count(F.lit(1)).alias("_values"),
        F.sum(count * F.ln(count)).alias("_n_ln_n"),
    )
    # -sum(p ln p) = ln(n) - sum(c ln c) / n; exactly 0 for a constant rater
    entropy = F.when(F.col("_values") == 1, F.lit(0.0)).otherwise(F.ln("_n") - F.col("_n_ln_n") / F.col("_n"))
    return summed.select(user_col, "mode_rating", entropy.alias("entropy_rating"))


def _rated(df: DataFrame, user_col: str, rating_col: str) -> DataFrame:
    return df.select(F.col(user_col), F.col(rating_col).cast("double").alias("_rating")).filter(
        F.col(user_col).isNotNull() & is_number("_rating")
    )


def rating_histogram(df: DataFrame, user_col: str = "user_id", rating_col: str = "rating") -> DataFrame:
    """Count and share of each distinct rating of each rater.

    The counts are written once, and the totals come from them: the ratings are read and shuffled
    one time. The total is joined back rather than taken by a window, so that adaptive execution
    can split a rater with very many distinct values. Runs two jobs.
    """
    histogram = cut_lineage(_histogram(_rated(df, user_col, rating_col), user_col))
    totals = cut_lineage(histogram.groupBy(user_col).agg(F.sum("_count").alias("total_count")))
    return histogram.join(totals, user_col).select(
        user_col,
        F.col("_rating").alias(rating_col),
        F.col("_count").alias("rating_count"),
        "total_count",
        (F.col("_count") / F.col("total_count")).alias("share"),
    )


def tied_modes(df: DataFrame, user_col: str = "user_id", rating_col: str = "rating") -> DataFrame:
    """All ratings that share a rater's highest count; joined like :func:`rating_histogram`. Runs two jobs."""
    histogram = cut_lineage(_histogram(_rated(df, user_col, rating_col), user_col))
    highest = cut_lineage(histogram.groupBy(user_col).agg(F.max("_count").alias("max_count")))
    return (
        histogram.join(highest, user_col)
        .filter(F.col("_count") == F.col("max_count"))
        .select(user_col, F.col("_rating").alias(rating_col), F.col("_count").alias("rating_count"))
    )


def user_mode(df: DataFrame, user_col: str = "user_id", rating_col: str = "rating") -> DataFrame:
    """Most frequent rating of each rater, the smallest of tied ones."""
    histogram = _histogram(_rated(df, user_col, rating_col), user_col)
    return _mode_and_entropy(histogram, user_col).select(user_col, "mode_rating")


def user_entropy(df: DataFrame, user_col: str = "user_id", rating_col: str = "rating") -> DataFrame:
    """Entropy in nats of each rater's rating distribution."""
    histogram = _histogram(_rated(df, user_col, rating_col), user_col)
    return _mode_and_entropy(histogram, user_col).select(user_col, "entropy_rating")


def _without_nan(df: DataFrame, rating_col: str) -> Column:
    value = F.col(rating_col).cast("double")
    return F.when(~F.isnan(value), value)


def core_features(df: DataFrame, user_col: str = "user_id", rating_col: str = "rating") -> DataFrame:
    """The three model features of each rater, as used for scoring.

    Missing ratings are ignored; a rater without any stays in the result with null features.
    Ratings without a rater are left out.
    """
    require_columns(df, [user_col, rating_col])
    rated = df.filter(F.col(user_col).isNotNull()).select(
        F.col(user_col), _without_nan(df, rating_col).alias("_rating")
    )
    return rated.groupBy(user_col).agg(*_moments(CORE_FEATURES))


def combined_features(
    df: DataFrame, user_col: str = "user_id", rating_col: str = "rating", name: str = "Combined"
) -> DataFrame:
    """The three model features of all ratings taken as one rater."""
    require_columns(df, [rating_col])
    rated = df.select(_without_nan(df, rating_col).alias("_rating"))
    return rated.agg(*_moments(CORE_FEATURES)).select(F.lit(name).alias(user_col), *CORE_FEATURES)
