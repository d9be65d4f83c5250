"""The labelled table of human and machine raters."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import encode_id
from ..schemas import CORE_FEATURES, STATISTICS
from .cleaning import conform
from .sampling import sample_about

# Determinant of a correlation matrix below which features count as collinear.
_SINGULAR = 1e-12


def with_label(df: DataFrame, label: int, user_col: str = "user_id") -> DataFrame:
    """Add ``ai_label`` and append it to the id, so that ids of both sources stay apart."""
    return df.withColumn(user_col, encode_id(user_col, label)).withColumn("ai_label", F.lit(label))


def labelled_dataset(
    human: DataFrame,
    machine: DataFrame,
    n_human: int | None = 4000,
    seed: int = 42,
    features: Sequence[str] = STATISTICS,
) -> DataFrame:
    """About ``n_human`` human raters and all machine raters, labelled, in the fixed column order.

    Columns are matched by name. Raters whose id cannot carry the label are left out; count them
    with :func:`rejected_ids`.
    """
    if n_human is not None:
        human = sample_about(human, n_human, ["user_id"], seed)
    both = with_label(human, 0).unionByName(with_label(machine, 1))
    return conform(both, ["user_id", *features, "ai_label"]).filter(F.col("user_id").isNotNull())


def rejected_rows(df: DataFrame, label: int, user_col: str = "user_id") -> DataFrame:
    """The rows themselves whose id cannot carry the label digit, with the label."""
    return df.filter(encode_id(user_col, label).isNull()).withColumn("ai_label", F.lit(label))


def rejected_ids(df: DataFrame, label: int, user_col: str = "user_id") -> DataFrame:
    """Number of rows whose id cannot carry the label digit."""
    return df.agg(F.count_if(encode_id(user_col, label).isNull()).alias("rejected"))


def class_means(
    df: DataFrame, features: Sequence[str] = CORE_FEATURES, label: str = "ai_label"
) -> DataFrame:
    """Mean of each feature per class."""
    return df.groupBy(label).agg(*[F.avg(f).alias(f) for f in features])


def class_counts(df: DataFrame, label: str = "ai_label") -> DataFrame:
    """Rows per class."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def correlation_pairs(df: DataFrame, features: Sequence[str] = CORE_FEATURES) -> DataFrame:
    """One row per feature pair with its Pearson correlation; one aggregation for all pairs."""
    pairs = list(combinations(features, 2))
    row = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    entries = F.array(
        *[F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(f"{a}|{b}").alias("corr")) for a, b in pairs]
    )
    return row.select(F.inline(entries))


def variance_inflation(df: DataFrame, features: Sequence[str] = CORE_FEATURES) -> DataFrame:
    """Variance-inflation factor of each feature: the diagonal of the inverse correlation matrix.

    Lazy and closed-form for three features. For other numbers the correlations, k*(k-1)/2
    doubles, are brought to the driver and inverted there. Null where features are collinear.
    """
    features = list(features)
    if len(features) == 3:
        return _three_feature_vif(df, features)
    row = df.agg(*[F.corr(a, b) for a, b in combinations(features, 2)]).first()
    matrix = np.eye(len(features))
    for value, (i, j) in zip(row, combinations(range(len(features)), 2)):
        matrix[i, j] = matrix[j, i] = np.nan if value is None else value
    if np.isfinite(matrix).all() and np.linalg.det(matrix) > _SINGULAR:
        factors = [float(v) for v in np.diag(np.linalg.inv(matrix))]
    else:
        factors = [None] * len(features)
    return df.sparkSession.createDataFrame(list(zip(features, factors)), "feature string, vif double")


def _three_feature_vif(df: DataFrame, features: Sequence[str]) -> DataFrame:
    a, b, c = features
    row = df.agg(F.corr(a, b).alias("ab"), F.corr(a, c).alias("ac"), F.corr(b, c).alias("bc"))
    ab, ac, bc = F.col("ab"), F.col("ac"), F.col("bc")
    determinant = F.lit(1.0) + 2.0 * ab * ac * bc - ab * ab - ac * ac - bc * bc
    opposite = {a: bc, b: ac, c: ab}
    entries = F.array(
        *[
            F.struct(
                F.lit(f).alias("feature"),
                F.when(determinant > _SINGULAR, (1.0 - r * r) / determinant).alias("vif"),
            )
            for f, r in opposite.items()
        ]
    )
    return row.select(F.inline(entries))
