"""Text cleaning and strict number parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Decimal and exponent notation only: no type suffix, no "nan" or "inf", no digit separators.
_NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


# Every character Python strips as white space; all are at or below the ideographic space.
WHITE_SPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def clean_text(value: Column | str) -> Column:
    """Value as text without leading and trailing white space of any kind."""
    return F.btrim(_column(value).cast("string"), F.lit(WHITE_SPACE))


def default_text(value: Column | str, default: str = "") -> Column:
    """Text of a field that may be absent."""
    return F.coalesce(_column(value).cast("string"), F.lit(default))


def strict_double(value: Column | str) -> Column:
    """Double read from trimmed text, null unless the whole text is a plain number."""
    text = clean_text(value)
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))
