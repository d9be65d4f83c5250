"""Row filters, column checks and projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import MissingColumnsError


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Return ``df`` unchanged, or raise before any job runs when a column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise MissingColumnsError(missing, df.columns)
    return df


def default_columns(df: DataFrame) -> tuple[str, str]:
    """User and rating column of an unknown table: its first and second column."""
    if len(df.columns) < 2:
        raise MissingColumnsError(["<user column>", "<rating column>"], df.columns)
    return df.columns[0], df.columns[1]


def conform(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exactly ``columns``, in that order."""
    return require_columns(df, columns).select(*columns)


def drop_incomplete(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a null or NaN in any column, or in ``subset`` only.

    Naming a subset lets the scan read just the columns that are used afterwards.
    """
    return df.dropna("any", subset=list(subset) if subset else None)


def is_number(column: Column | str) -> Column:
    """Whether a numeric column holds a value: neither null nor NaN."""
    value = F.col(column) if isinstance(column, str) else column
    return value.isNotNull() & ~F.isnan(value.cast("double"))


def drop_missing(df: DataFrame, column: str) -> DataFrame:
    """Drop rows whose ``column`` is null or NaN; other columns may stay null."""
    return df.filter(is_number(column))


def only_user(df: DataFrame, user_col: str, user: object) -> DataFrame:
    """Rows of one user, compared as text so that 12 and "12" are the same user."""
    return df.filter(F.col(user_col).cast("string") == F.lit(str(user)))
