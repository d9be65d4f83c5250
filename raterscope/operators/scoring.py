"""Scoring of new rating tables with a fitted model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import NoDataError
from ..functions.labels import label_name
from ..schemas import CORE_FEATURES
from .cleaning import default_columns, only_user, require_columns
from .statistics import combined_features, core_features
from .validation import Model, score_column

OK = "ok"
UNDEFINED_FEATURES = "undefined_features"
NO_VALID_RATINGS = "no_valid_ratings"


def _defined():
    defined = F.lit(True)
    for feature in CORE_FEATURES:
        defined = defined & F.col(feature).isNotNull()
    return defined


def with_status(features: DataFrame, otherwise: str = UNDEFINED_FEATURES) -> DataFrame:
    """Add ``status``: ``ok`` where every model feature is defined."""
    return features.withColumn("status", F.when(_defined(), OK).otherwise(otherwise))


def score_stats(features: DataFrame, user_col: str = "user_id") -> DataFrame:
    """The features under their display names, id column first."""
    return features.select(
        user_col,
        F.col("sd_rating").alias("SD"),
        F.col("skewness_rating").alias("Skewness"),
        F.col("kurtosis_rating").alias("Kurtosis"),
    )


def apply_model(model: Model, features: DataFrame, user_col: str = "user_id") -> DataFrame:
    """Class name and probability of being a machine; null where the features are undefined."""
    scored = model.transform(features)
    valid = F.col("status") == OK
    return scored.select(
        user_col,
        F.when(valid, label_name("prediction")).alias("Prediction"),
        F.when(valid, score_column(model, scored.columns)).alias("Probability AI"),
        "status",
    )


def score_raters(
    model: Model,
    ratings: DataFrame,
    user_col: str | None = None,
    rating_col: str | None = None,
    target_user: object = None,
) -> tuple[DataFrame, DataFrame]:
    """Predictions and statistics of every rater, or of ``target_user`` only.

    Without column names the first two columns are used. The rating column is cast to numbers
    and what is no number counts as missing. A rater whose features are undefined (one rating,
    or all equal) is reported with status ``undefined_features``. An unknown target raises.
    """
    rated, shown = as_upload(ratings, user_col, rating_col)
    if target_user is not None:
        rated = only_user(rated, "user_id", target_user)
        if rated.isEmpty():
            raise NoDataError(f"no ratings of user {target_user}")
    return _results(model, with_status(core_features(rated)), shown)


def score_combined(
    model: Model, ratings: DataFrame, user_col: str | None = None, rating_col: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Prediction and statistics of all ratings taken as one rater."""
    rated, shown = as_upload(ratings, user_col, rating_col)
    return _results(model, with_status(combined_features(rated), NO_VALID_RATINGS), shown)


def _results(model: Model, features: DataFrame, shown: str) -> tuple[DataFrame, DataFrame]:
    tables = apply_model(model, features), score_stats(features)
    return tuple(t.withColumnRenamed("user_id", shown) for t in tables)


def as_upload(
    ratings: DataFrame, user_col: str | None, rating_col: str | None
) -> tuple[DataFrame, str]:
    """``user_id`` and numeric ``rating`` of an uploaded table, and the name its users go by."""
    if user_col is None or rating_col is None:
        first, second = default_columns(ratings)
        user_col, rating_col = user_col or first, rating_col or second
    require_columns(ratings, [user_col, rating_col])
    user, rating = (F.col("`" + name.replace("`", "``") + "`") for name in (user_col, rating_col))
    return ratings.select(user.alias("user_id"), rating.try_cast("double").alias("rating")), user_col
