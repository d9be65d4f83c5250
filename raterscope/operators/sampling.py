"""Repeatable samples of rows and users."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import NotEnoughUsersError
from ..functions.seeded import pick, seeded_key, unit_interval
from .ranking import hashed_rank

# Sampling temperatures a synthetic rater may be given.
TEMPERATURES = (1.0, 0.8, 0.5, 0.25, 0.1, 0.01)

# Spark prunes a row_number() cut before the shuffle only up to this rank
# (spark.sql.optimizer.windowGroupLimitThreshold).
_MAP_SIDE_RANK_LIMIT = 1000
_SALTS = 64


def _rank_cut(df: DataFrame, keys: Sequence[str], order: Sequence[str], cut: int) -> DataFrame:
    inside = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(inside)).filter(F.col("_rank") <= cut)


def sample_per_user(
    df: DataFrame,
    k: int,
    row_id: Sequence[str],
    seed: int = 42,
    min_count: int = 0,
    user_col: str = "user_id",
) -> DataFrame:
    """``k`` random ratings of each user (all, if fewer), of users with at least ``min_count``.

    Ranking stops at ``max(k, min_count)`` rows per user, and a user has enough ratings exactly
    if the rank reached ``min_count``. So the activity filter needs no count, no join and no
    second scan, and each map task sends at most that many rows of one user. Above Spark's limit for that pruning the cut
    is made per (user, salt) first, which keeps the same rows.

    Ratings without a user are left out.

    ``row_id`` names integer or string columns that tell the rows of a user apart; rows that
    agree on them are ordered by their other columns.
    """
    cut = max(k, min_count)
    rest = [c for c in df.columns if c != user_col and c not in row_id]
    keyed = df.filter(F.col(user_col).isNotNull()).withColumn("_order", seeded_key(seed, user_col, *row_id))
    order = ["_order", *row_id, *rest]
    if cut > _MAP_SIDE_RANK_LIMIT:
        salted = keyed.withColumn("_salt", F.pmod(F.xxhash64("_order"), F.lit(_SALTS)))
        keyed = _rank_cut(salted, [user_col, "_salt"], order, cut).drop("_salt", "_rank")
    ranked = _rank_cut(keyed, [user_col], order, cut)
    if min_count > 1:
        # At most ``cut`` rows of a user are left here, so this whole-group frame is bounded.
        reached = F.max("_rank").over(Window.partitionBy(user_col))
        ranked = ranked.withColumn("_reached", reached).filter(F.col("_reached") >= min_count)
    return ranked.filter(F.col("_rank") <= k).select(*df.columns)


def sample_about(df: DataFrame, n: int, row_id: Sequence[str], seed: int = 42) -> DataFrame:
    """About ``n`` rows: each row is kept with probability ``n / count``, all if there are fewer.

    The draw hashes ``row_id``, so it does not depend on partitioning; an empty source stays empty.
    """
    rows = df.agg(F.count(F.lit(1)).alias("_rows")).scalar()
    fraction = F.try_divide(F.lit(float(n)), rows)
    return df.filter(unit_interval(seeded_key(seed, *row_id)) < fraction)


def sample_users(df: DataFrame, n: int, seed: int = 42, user_col: str = "user_id") -> DataFrame:
    """Exactly ``n`` distinct users without replacement (lazy; all of them if there are fewer).

    The ``n`` smallest seeded keys, found by distributed rank instead of one global sort.
    """
    users = df.filter(F.col(user_col).isNotNull()).select(user_col).distinct()
    ranked = hashed_rank(users.withColumn("_all", F.lit(0)), ["_all"], seeded_key(seed, user_col))
    return ranked.filter(F.col("rank") <= n).select(user_col)


def require_users(df: DataFrame, n: int, user_col: str = "user_id") -> DataFrame:
    """Return ``df``, or raise when it has fewer than ``n`` distinct users. Runs one job."""
    users = df.filter(F.col(user_col).isNotNull()).select(user_col).distinct()
    found = users.count()
    if found < n:
        raise NotEnoughUsersError(f"{n} users wanted, source has {found}")
    return df


def assign_choice(
    df: DataFrame,
    choices: Sequence[float] = TEMPERATURES,
    seed: int = 42,
    key: str = "user_id",
    name: str = "temperature",
) -> DataFrame:
    """Give each key one of ``choices`` at random; the same key always gets the same one."""
    return df.withColumn(name, pick(choices, seeded_key(seed, F.lit(name), key)))
