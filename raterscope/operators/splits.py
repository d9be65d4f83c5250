"""Class balancing, stratified folds and learning-curve subsets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.seeded import seeded_key
from .ranking import hashed_rank


def _ranked_by_class(df: DataFrame, label: str, row_id: Sequence[str], seed: int) -> DataFrame:
    return hashed_rank(
        df.filter(F.col(label).isNotNull()), [label], seeded_key(seed, *row_id), "_class_rank", "_class_size"
    )


def _cut_at_smallest(df: DataFrame, ranked: DataFrame, label: str) -> DataFrame:
    sizes = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("_rows"))
    return ranked.filter(F.col("_class_rank") <= sizes.agg(F.min("_rows")).scalar())


def balance_classes(
    df: DataFrame, label: str = "ai_label", row_id: Sequence[str] = ("user_id",), seed: int = 42
) -> DataFrame:
    """Cut every class at random to the size of the smallest one."""
    ranked = _ranked_by_class(df, label, row_id, seed)
    return _cut_at_smallest(df, ranked, label).select(*df.columns)


def assign_folds(
    df: DataFrame,
    label: str = "ai_label",
    k: int = 6,
    row_id: Sequence[str] = ("user_id",),
    seed: int = 42,
) -> DataFrame:
    """Add ``fold`` in 0..k-1 such that each class is spread evenly: sizes differ by one at most."""
    ranked = _ranked_by_class(df, label, row_id, seed)
    fold = ((F.col("_class_rank") - 1) % k).cast("int")
    return ranked.withColumn("fold", fold).select(*df.columns, "fold")


def balanced_folds(
    df: DataFrame,
    label: str = "ai_label",
    k: int = 6,
    row_id: Sequence[str] = ("user_id",),
    seed: int = 42,
) -> DataFrame:
    """Balanced classes and their folds from a single ranking; equals folding the balanced table."""
    ranked = _ranked_by_class(df, label, row_id, seed)
    fold = ((F.col("_class_rank") - 1) % k).cast("int")
    return _cut_at_smallest(df, ranked, label).withColumn("fold", fold).select(*df.columns, "fold")


def learning_subsets(
    df: DataFrame,
    steps: int = 10,
    row_id: Sequence[str] = ("user_id",),
    seed: int = 42,
    k: int = 6,
) -> DataFrame:
    """Training rows of each held-out fold, with the first learning-curve step that uses them.

    Step ``s`` of fold ``f`` trains on the rows with ``held_out = f`` and ``first_step <= s``:
    the ``floor(s / steps * size)`` smallest seeded keys among the rows outside the fold.
    Rows are repeated ``k - 1`` times, once for every fold they help to train.
    """
    held_out = F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    training = df.withColumn("held_out", held_out).filter(F.col("held_out") != F.col("fold"))
    ranked = hashed_rank(training, ["held_out"], seeded_key(seed, *row_id), "train_rank", "train_size")
    # floor(s * size / steps) >= rank  <=>  s >= ceil(rank * steps / size), in whole numbers
    first = F.floor((F.col("train_rank") * steps + F.col("train_size") - 1) / F.col("train_size"))
    return ranked.withColumn("first_step", first.cast("int")).select(
        *df.columns, "held_out", "train_rank", "train_size", "first_step"
    )
