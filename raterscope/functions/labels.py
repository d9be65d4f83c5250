"""Source labels and ids that carry them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Class codes and the names shown for them.
LABEL_NAMES = {0: "Human", 1: "AI"}
UNKNOWN_LABEL = "Unknown"


def label_name(label: Column | str) -> Column:
    """Class name of a numeric code, ``Unknown`` for any other code or null."""
    code = F.col(label) if isinstance(label, str) else label
    named = F.lit(None).cast("string")
    for value, name in LABEL_NAMES.items():
        named = F.when(code == value, F.lit(name)).otherwise(named)
    return F.coalesce(named, F.lit(UNKNOWN_LABEL))


def encode_id(user_id: Column | str, label: int) -> Column:
    """Id with the label digit appended; null where the result is not a long.

    A null or an id of 19 digits would stop the job under ANSI rules, so the cast is a ``try``
    and the caller counts the rejects.
    """
    column = F.col(user_id) if isinstance(user_id, str) else user_id
    return F.concat(column.cast("string"), F.lit(str(label))).try_cast("bigint")
