"""Ranks and running totals over groups that may hold most of the table.

``row_number()`` or a running ``sum()`` over one class puts all its rows into one task. Both
functions here cut each group into slots, work inside a slot, and add the totals of the slots
before it, which are few enough to be joined as a small table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

_SLOTS = 1024
# Rows, of all groups together, that the slot borders are taken from.
_BORDER_SAMPLE = 1_000_000
# Number of splitters at or below the value: binary search, one array element per halving step.
# Never null, and said so: a null check before the join would repeat the search.
_SLOT_OF = (
    "coalesce(aggregate(array(512, 256, 128, 64, 32, 16, 8, 4, 2, 1), 0, "
    "(at, step) -> if(element_at(_splitters, at + step) <= {value}, at + step, at)), 0)"
)


def hashed_rank(
    df: DataFrame,
    by: Sequence[str],
    key: Column,
    rank: str = "rank",
    size: str = "group_size",
    prefix: int = 3,
) -> DataFrame:
    """Add the 1-based rank by ``key`` inside each ``by`` group, and the group's size.

    ``key`` must be a seeded key: its hex digits are uniform, so slots of ``prefix`` digits
    (4096 for 3) are of nearly equal size whatever the groups look like. The offsets are
    ``16**prefix`` rows per group at most; groups are classes or folds, never users.
    The input is read twice; cut its lineage first when it is costly.
    """
    by = list(by)
    keyed = df.withColumn("_key", key).withColumn("_slot", F.substring("_key", 1, prefix))
    slots = keyed.groupBy(*by, "_slot").agg(F.count(F.lit(1)).alias("_slot_rows"))
    group = Window.partitionBy(*by)
    offsets = slots.select(
        *by,
        "_slot",
        (F.sum("_slot_rows").over(group.orderBy("_slot")) - F.col("_slot_rows")).alias("_before"),
        F.sum("_slot_rows").over(group).alias(size),
    )
    inside = Window.partitionBy(*by, "_slot").orderBy("_key")
    return (
        keyed.withColumn("_local", F.row_number().over(inside))
        .join(offsets, [*by, "_slot"])
        .withColumn(rank, F.col("_before") + F.col("_local"))
        .drop("_key", "_slot", "_local", "_before")
    )


def totals_before(
    df: DataFrame, by: Sequence[str], order: str, values: Sequence[str]
) -> DataFrame:
    """Add ``<value>_before`` (sum over strictly smaller ``order``) and ``<value>_total`` per group.

    ``df`` must be unique on ``by`` and ``order``, which must not be null. Slot borders are
    approximate quantiles of a hashed sample, so each of the 1024 slots of a group holds about a
    thousandth of its rows for any distribution; they balance the slots and do not affect results.
    Groups are folds and models, a handful with one array of borders each: that table is small by
    construction, and is broadcast. The input is written once, as the borders, the slot totals and
    the rows each read it. Runs two jobs.
    """
    by, columns = list(by), df.columns
    df = cut_lineage(df)
    fractions = ", ".join(f"{i / _SLOTS!r}D" for i in range(1, _SLOTS))
    share = min(1.0, _BORDER_SAMPLE / max(df.count(), 1))
    drawn = df.filter(F.pmod(F.xxhash64(*by, order), F.lit(1 << 30)) < int(share * (1 << 30)))
    # The sample bounds what one task merges, however many rows a group has.
    splitters = drawn.groupBy(*by).agg(
        F.expr(f"percentile_approx({order}, array({fractions}), {20 * _SLOTS}) AS _splitters")
    )
    totals = df.groupBy(*by).agg(*[F.sum(v).alias(f"{v}_total") for v in values])
    borders = totals.join(splitters, by, "left")
    slotted = df.join(F.broadcast(borders), by).withColumn("_slot", F.expr(_SLOT_OF.format(value=order)))
    sums = slotted.groupBy(*by, "_slot").agg(*[F.sum(v).alias(f"_{v}_slot") for v in values])
    earlier = Window.partitionBy(*by).orderBy("_slot")
    offsets = sums.select(
        *by,
        "_slot",
        *[(F.sum(f"_{v}_slot").over(earlier) - F.col(f"_{v}_slot")).alias(f"_{v}_offset") for v in values],
    )
    inside = Window.partitionBy(*by, "_slot").orderBy(order)
    local = slotted.drop("_splitters").select(
        "*", *[(F.sum(v).over(inside) - F.col(v)).alias(f"_{v}_local") for v in values]
    )
    return local.join(offsets, [*by, "_slot"]).select(
        *columns,
        *[(F.col(f"_{v}_offset") + F.col(f"_{v}_local")).alias(f"{v}_before") for v in values],
        *[f"{v}_total" for v in values],
    )
