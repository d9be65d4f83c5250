"""Who rates how much: counts, activity filter, distinct users."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def ratings_per_user(df: DataFrame, user_col: str = "user_id") -> DataFrame:
    """Number of ratings of every user."""
    return df.groupBy(user_col).agg(F.count(F.lit(1)).alias("n_ratings"))


def qualified_users(df: DataFrame, min_count: int = 300, user_col: str = "user_id") -> DataFrame:
    """Users with at least ``min_count`` ratings."""
    return ratings_per_user(df, user_col).filter(F.col("n_ratings") >= min_count).select(user_col)


def keep_users(df: DataFrame, users: DataFrame, user_col: str = "user_id") -> DataFrame:
    """Ratings of the listed users.

    A semi-join: the users side cannot multiply rows. That side is written first. The planner
    then knows whether it is small enough to broadcast; if not, it is a plain scan, and adaptive
    execution can split the partition of a very active rater. It could not do so if the side
    came straight from an aggregation, whose partitioning the join would take over.
    """
    return df.join(cut_lineage(users.select(user_col)), user_col, "left_semi")


def qualified_ratings(df: DataFrame, min_count: int = 300, user_col: str = "user_id") -> DataFrame:
    """Every rating of every user with at least ``min_count`` ratings."""
    return keep_users(df, qualified_users(df, min_count, user_col), user_col)


def distinct_users(df: DataFrame, user_col: str = "user_id", relative_error: float | None = None) -> DataFrame:
    """Number of users, exact, or estimated in one pass when an error is allowed.

    The exact count groups first and counts the groups, so that it is spread over all tasks.
    """
    if relative_error is not None:
        return df.agg(F.approx_count_distinct(user_col, relative_error).alias("n_users"))
    users = df.filter(F.col(user_col).isNotNull()).select(user_col).distinct()
    return users.agg(F.count(F.lit(1)).alias("n_users"))


def distinct_values(df: DataFrame, column: str, name: str = "value") -> DataFrame:
    """Distinct values of a column as text, for pickers and class lists."""
    return df.select(F.col(column).cast("string").alias(name)).distinct()


def summarise_output(df: DataFrame, user_col: str = "user_id") -> DataFrame:
    """Row and user count of a stage's output. Pass the written table, so that the stage is not run again."""
    per_user = ratings_per_user(df, user_col)
    return per_user.agg(
        F.coalesce(F.sum("n_ratings"), F.lit(0)).cast("bigint").alias("n_rows"),
        F.count(F.col(user_col)).alias("n_users"),
    )


def preview(df: DataFrame, order_by: list[str], n: int = 5) -> DataFrame:
    """First ``n`` rows in a stated order."""
    return df.orderBy(*order_by).limit(n)
