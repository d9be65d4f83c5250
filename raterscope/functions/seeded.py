"""Repeatable pseudo-randomness from keys.

``rand()`` depends on partitioning and changes when a lost task is run again. A hash of seed and
row key does neither: the same rows come out on any cluster size, after any retry, and in any SQL
engine that has md5.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SLOT_HEX_DIGITS = 8


def seeded_key(seed: int, *columns: Column | str) -> Column:
    """Hex text whose order is a random permutation of the given integer or string keys."""
    parts = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def _leading_integer(key: Column) -> Column:
    return F.conv(F.substring(key, 1, SLOT_HEX_DIGITS), 16, 10).cast("bigint")


def unit_interval(key: Column) -> Column:
    """Number in [0, 1) taken from the head of a seeded key."""
    return _leading_integer(key) / F.lit(float(16**SLOT_HEX_DIGITS))


def pick(values: Sequence[float], key: Column) -> Column:
    """One of ``values``, chosen by a seeded key."""
    choices = F.expr(f"array({', '.join(f'{float(v)!r}D' for v in values)})")
    return F.element_at(choices, (_leading_integer(key) % len(values) + 1).cast("int"))
