"""Declared schemas and fixed names of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

STATISTICS = (
    "mean_rating",
    "median_rating",
    "mode_rating",
    "sd_rating",
    "max_rating",
    "min_rating",
    "iqr_rating",
    "kurtosis_rating",
    "skewness_rating",
    "entropy_rating",
)
CORE_FEATURES = ("sd_rating", "kurtosis_rating", "skewness_rating")
PLOT_FEATURES = ("mode_rating", "mean_rating", "kurtosis_rating", "iqr_rating", "entropy_rating")
DATASET_COLUMNS = ("user_id", *STATISTICS, "ai_label")


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields.items()])


RATINGS = _struct(
    user_id=T.LongType(), movie=T.StringType(), movie_id=T.LongType(), rating=T.DoubleType()
)

SYNTHETIC_RATINGS = _struct(
    movie=T.StringType(),
    user_id=T.LongType(),
    movie_id=T.LongType(),
    temperature=T.DoubleType(),
    rating=T.DoubleType(),
)

USER_STATISTICS = T.StructType(
    [T.StructField("user_id", T.LongType(), True)]
    + [T.StructField(name, T.DoubleType(), True) for name in STATISTICS]
)

ML_DATASET = T.StructType(
    USER_STATISTICS.fields + [T.StructField("ai_label", T.IntegerType(), False)]
)
