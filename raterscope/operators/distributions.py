"""Distribution tables: the numbers behind histograms and density curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import PLOT_FEATURES
from .cleaning import is_number

GRID_POINTS = 200


def integer_histogram(df: DataFrame, column: str = "rating") -> DataFrame:
    """Count per whole-number bin from floor(min) to ceil(max); empty bins are kept.

    The value range is taken from the counted bins, not by a second scan.
    """
    rated = df.filter(is_number(column)).select(F.col(column).cast("double").alias("_value"))
    counted = rated.groupBy(F.floor("_value").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.ceil("_value")).alias("_top")
    )
    bounds = counted.agg(F.min("bin").alias("lo"), F.max("_top").alias("hi"))
    bins = bounds.filter(F.col("lo").isNotNull()).select(F.explode(F.sequence("lo", "hi")).alias("bin"))
    return bins.join(counted, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def first_user_histogram(df: DataFrame, user_col: str = "user_id", rating_col: str = "rating") -> DataFrame:
    """Integer histogram of the smallest user id that has a rating; a scalar lookup, no sort.

    Ids in text are ordered as numbers if all of them are whole numbers, else as text.
    """
    rated = df.filter(F.col(user_col).isNotNull() & is_number(rating_col))
    first = F.min(user_col)
    if dict(df.dtypes)[user_col] == "string":
        number = F.when(F.col(user_col).rlike(r"^[+-]?[0-9]{1,38}$"), F.col(user_col).try_cast("decimal(38,0)"))
        by_number = F.min_by(user_col, F.struct(number, F.col(user_col)))
        first = F.when(F.bool_and(number.isNotNull()), by_number).otherwise(first)
    first = rated.agg(first).scalar()
    return integer_histogram(rated.filter(F.col(user_col) == first), rating_col)


def _long_form(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    entries = ", ".join(f"'{f}', double({f})" for f in features)
    long = df.selectExpr(label, f"stack({len(features)}, {entries}) AS (feature, value)")
    return long.filter(is_number("value"))


def _feature_shapes(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Range, size and spread per feature and class: one aggregation to one row per class."""

    def shape(feature: str) -> str:
        value = f"nullif(double({feature}), double('NaN'))"
        return (
            f"named_struct('feature', '{feature}', 'lo', min({value}), 'hi', max({value}), "
            f"'_n', count({value}), '_sd', stddev_samp({value}))"
        )

    shapes = F.expr(f"array({', '.join(shape(f) for f in features)})")
    per_class = df.groupBy(label).agg(shapes.alias("_shapes"))
    return per_class.select(label, F.inline("_shapes")).filter("_n > 0")


def feature_histogram(
    df: DataFrame, features: Sequence[str] = PLOT_FEATURES, label: str = "ai_label", bins: int = 30
) -> DataFrame:
    """``bins`` equal-width bins per feature and class, empty bins included.

    The maximum belongs to the last bin. A constant feature is given a range of one around its
    value. The ranges, one row per feature and class, are broadcast, so only bin counts are shuffled.
    """
    constant = F.col("lo") == F.col("hi")
    ranges = _feature_shapes(df, features, label).select(
        "feature",
        label,
        F.when(constant, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(constant, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )
    position = F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins) + 1
    counted = (
        _long_form(df, features, label)
        .join(F.broadcast(ranges), ["feature", label])
        .groupBy("feature", label, F.least(position, F.lit(bins)).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    width = (F.col("hi") - F.col("lo")) / bins
    grid = ranges.withColumn("bin", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(bins).cast("bigint"))))
    return grid.join(counted, ["feature", label, "bin"], "left").select(
        "feature",
        label,
        "bin",
        (F.col("lo") + width * (F.col("bin") - 1)).alias("bin_start"),
        (F.col("lo") + width * F.col("bin")).alias("bin_end"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def feature_density(
    df: DataFrame,
    features: Sequence[str] = PLOT_FEATURES,
    label: str = "ai_label",
    points: int = GRID_POINTS,
    bins: int = 30,
) -> DataFrame:
    """Gaussian kernel density on ``points`` grid positions per feature and class.

    Bandwidth is sd * n^(-1/5). ``scaled`` is the density times rows times histogram bin width,
    the height at which it overlays the histogram. A constant feature has no density: one row
    with nulls. Equal values are counted first; each distinct value then adds to a fixed number
    of grid positions inside its own task and is summed there, so the second shuffle carries
    grid rows only, never value pairs.
    """
    width = F.col("hi") - F.col("lo")
    bandwidth = F.when(width > 0, F.col("_sd") * F.pow(F.col("_n").cast("double"), F.lit(-0.2)))
    shapes = _feature_shapes(df, features, label).select(
        "feature", label, "lo", "hi", "_n", bandwidth.alias("_h")
    )
    values = (
        _long_form(df, features, label)
        .groupBy("feature", label, "value")
        .agg(F.count(F.lit(1)).alias("weight"))
    )
    at = F.col("lo") + width * F.col("point") / (points - 1)
    # Beyond 39 bandwidths the kernel is exactly 0 in double precision.
    place = (F.col("value") - F.col("lo")) / width * (points - 1)
    reach = 39.0 * F.col("_h") / width * (points - 1) + 1
    near = (
        F.greatest(F.lit(0.0), F.floor(place - reach)).cast("int"),
        F.least(F.lit(points - 1.0), F.ceil(place + reach)).cast("int"),
    )
    away = (at - F.col("value")) / F.col("_h")
    summed = (
        values.join(F.broadcast(shapes), ["feature", label])
        .filter(F.col("_h").isNotNull())
        .withColumn("point", F.explode(F.sequence(*near)))
        .groupBy("feature", label, "point")
        .agg(F.sum(F.col("weight") * F.exp(-0.5 * away * away)).alias("_sum"))
    )
    last = F.when(F.col("_h").isNull(), F.lit(0)).otherwise(F.lit(points - 1))
    grid = shapes.withColumn("point", F.explode(F.sequence(F.lit(0), last)))
    # A grid point that no value reaches has density 0; only a constant feature has none.
    total = F.when(F.col("_h").isNotNull(), F.coalesce("_sum", F.lit(0.0)))
    density = total / (F.col("_n") * F.col("_h") * F.sqrt(F.lit(2.0) * F.pi()))
    return grid.join(summed, ["feature", label, "point"], "left").select(
        "feature",
        label,
        "point",
        at.alias("x"),
        density.alias("density"),
        (density * F.col("_n") * width / bins).alias("scaled"),
    )
