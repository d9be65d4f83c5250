"""Exact k-nearest-neighbour classification without comparing all pairs.

Training points are cut into leaves of about ``leaf_rows`` points by a k-d tree whose borders
come from a bounded sample. A query is searched in its own leaf first; the distance of its k-th
neighbour there tells which other leaves can hold a closer point, and only these are searched
next. Both searches join queries and points on the leaf and keep ``k`` rows per query. Leaves
that attract many queries are cut into pieces, so no task holds more than one leaf and one block
of queries. Copies of a point beyond the ``k`` smallest ids can never be among the neighbours
(ties go to the smaller id), so a mass of equal raters does not fill a leaf.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.seeded import seeded_key, unit_interval
from ..schemas import CORE_FEATURES
from ..session import cut_lineage
from .cleaning import is_number

# Ship the functions below with the tasks: executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEAF_ROWS = 2000
QUERY_BLOCK = 20_000
_SAMPLE_PER_LEAF = 32
# Rows of the sample at most: the tree is built on the driver. Beyond 260 million points leaves grow instead.
_SAMPLE_ROWS = 4_000_000
_DISTANCES_AT_ONCE = 4_000_000


@dataclass(frozen=True)
class _Tree:
    """Inner nodes have two children, leaves have -1 and a number."""

    depth: int
    dimension: np.ndarray
    border: np.ndarray
    children: np.ndarray
    number: np.ndarray

    def leaf(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), dtype=np.int64)
        rows = np.arange(len(points))
        for _ in range(self.depth):
            right = points[rows, self.dimension[node]] > self.border[node]
            below = self.children[node, right.astype(np.int64)]
            node = np.where(below < 0, node, below)
        return self.number[node]

    def boxes(self, leaves: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Box of every node around the boxes of the leaves; empty where no leaf has points."""
        shape = (len(self.number), low.shape[1])
        lows, highs = np.full(shape, np.inf), np.full(shape, -np.inf)
        node_of = np.full(self.number.max() + 1, -1)
        node_of[self.number[self.number >= 0]] = np.flatnonzero(self.number >= 0)
        lows[node_of[leaves]], highs[node_of[leaves]] = low, high
        for node in range(len(self.number) - 1, -1, -1):  # children come after their parent
            if self.children[node, 0] >= 0:
                lows[node] = lows[self.children[node]].min(axis=0)
                highs[node] = highs[self.children[node]].max(axis=0)
        return lows, highs


def _split(points: np.ndarray) -> tuple[int, float] | None:
    """Feature and border that leave points on both sides, at the median where it can be."""
    spread = points.max(axis=0) - points.min(axis=0)
    widest = int(np.argmax(spread))
    if not spread[widest] > 0:
        return None
    values = points[:, widest]
    border = float(np.median(values))
    if border >= values.max():
        # Over half the points share the largest value: they go right, all others left.
        border = float(values[values < border].max())
    return widest, border


def _build_tree(sample: np.ndarray, depth: int) -> _Tree:
    dimension, border, children, number = [], [], [], []
    queue, deepest, leaves = [(sample, 0, None)], 0, 0
    for points, level, above in queue:
        node = len(number)
        if above is not None:
            children[above[0]][above[1]] = node
        split = _split(points) if level < depth and len(points) > 1 else None
        dimension.append(split[0] if split else 0)
        border.append(split[1] if split else 0.0)
        children.append([-1, -1])
        number.append(-1 if split else leaves)
        if not split:
            leaves += 1
            continue
        deepest = max(deepest, level + 1)
        right = points[:, split[0]] > split[1]
        queue += [(points[~right], level + 1, (node, 0)), (points[right], level + 1, (node, 1))]
    return _Tree(deepest, np.array(dimension), np.array(border), np.array(children), np.array(number))


def _with_leaf(df: DataFrame, features: Sequence[str], tree: _Tree) -> DataFrame:
    if tree.depth == 0:
        return df.withColumn("_leaf", F.lit(0).cast("bigint"))

    @F.pandas_udf("bigint")
    def leaf(*columns: pd.Series) -> pd.Series:
        return pd.Series(tree.leaf(np.column_stack([c.to_numpy() for c in columns])))

    return df.withColumn("_leaf", leaf(*features))


def _nearest(points: np.ndarray, ids: np.ndarray, queries: np.ndarray, k: int):
    """Query row, point row and squared distance of the k nearest points, nearest first.

    ``ids`` must be ascending: equal distances are then resolved by column order.
    """
    k = min(k, len(points))
    block = max(1, _DISTANCES_AT_ONCE // len(points))
    found = []
    for start in range(0, len(queries), block):
        part = queries[start : start + block]
        distance = np.zeros((len(part), len(points)))
        for d in range(points.shape[1]):
            distance += (part[:, d, None] - points[None, :, d]) ** 2
        limit = np.partition(distance, k - 1, axis=1)[:, k - 1]
        row, column = np.nonzero(distance <= limit[:, None])
        near = distance[row, column]
        order = np.lexsort((column, near, row))
        row, column, near = row[order], column[order], near[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keep = rank < k
        found.append((row[keep] + start, column[keep], near[keep]))
    return tuple(np.concatenate(c) for c in zip(*found))


def _search(points: DataFrame, queries: DataFrame, features: Sequence[str], k: int) -> DataFrame:
    """Up to k neighbours from the given leaf for every query row, as arrays."""
    features = list(features)
    sizes = queries.groupBy("_leaf").count()
    pieces = sizes.select(
        "_leaf", F.ceil(F.col("count") / QUERY_BLOCK).cast("int").alias("_pieces")
    )
    # One row per leaf, and the number of leaves is limited by the sample.
    pieces = F.broadcast(pieces)
    cut_queries = queries.join(pieces, "_leaf").withColumn(
        "_piece", F.pmod(F.xxhash64("_query"), F.col("_pieces")).cast("int")
    ).drop("_pieces")
    copied = points.join(pieces, "_leaf").withColumn(
        "_piece", F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1))
    ).drop("_pieces")
    schema = T.StructType(
        [T.StructField("_query", T.LongType())]
        + [T.StructField(f, T.DoubleType()) for f in features]
        + [
            T.StructField("_leaf", T.LongType()),
            T.StructField("_ids", T.ArrayType(T.LongType())),
            T.StructField("_distances", T.ArrayType(T.DoubleType())),
            T.StructField("_labels", T.ArrayType(T.DoubleType())),
        ]
    )

    def search_leaf(point_rows: pd.DataFrame, query_rows: pd.DataFrame) -> pd.DataFrame:
        result = query_rows[["_query", *features, "_leaf"]].reset_index(drop=True)
        if result.empty or point_rows.empty:
            empty = [[] for _ in range(len(result))]
            return result.assign(_ids=empty, _distances=empty, _labels=empty)
        point_rows = point_rows.sort_values("_point")
        ids = point_rows["_point"].to_numpy()
        labels = point_rows["_label"].to_numpy()
        row, column, near = _nearest(
            point_rows[features].to_numpy(), ids, result[features].to_numpy(), k
        )
        # Every query has the same number of neighbours in this leaf.
        shape = (len(result), -1)
        return result.assign(
            _ids=list(ids[column].reshape(shape)),
            _distances=list(near.reshape(shape)),
            _labels=list(labels[column].reshape(shape)),
        )

    keys = ["_leaf", "_piece"]
    return (
        copied.groupBy(*keys).cogroup(cut_queries.groupBy(*keys)).applyInPandas(search_leaf, schema)
    )


def _other_leaves(
    searched: DataFrame, features: Sequence[str], k: int, tree: _Tree, lows: np.ndarray, highs: np.ndarray
) -> DataFrame:
    """For each query, the other leaves whose box reaches into the ball of its k-th neighbour.

    The tree is descended for many queries at a time, and only into boxes that the ball reaches.
    """
    features = list(features)
    schema = T.StructType(
        [T.StructField("_query", T.LongType())]
        + [T.StructField(f, T.DoubleType()) for f in features]
        + [T.StructField("_leaf", T.LongType())]
    )

    def probe(batches):
        for batch in batches:
            at = batch[features].to_numpy()
            reach = np.array([d[-1] if len(d) >= k else np.inf for d in batch["_distances"]])
            own = batch["_leaf"].to_numpy()
            row, node = np.arange(len(batch)), np.zeros(len(batch), dtype=np.int64)
            while len(row):
                outside = np.maximum(np.maximum(lows[node] - at[row], at[row] - highs[node]), 0.0)
                # The slack only ever adds a leaf that turns out not to be needed.
                near = (outside**2).sum(axis=1) <= reach[row] * (1 + 1e-9)
                near &= np.isfinite(lows[node]).all(axis=1)
                row, node = row[near], node[near]
                leaf = tree.number[node] >= 0
                found = leaf & (tree.number[node] != own[row])
                part = batch[["_query", *features]].iloc[row[found]].reset_index(drop=True)
                yield part.assign(_leaf=tree.number[node[found]])
                row, node = np.repeat(row[~leaf], 2), tree.children[node[~leaf]].ravel()

    return searched.mapInPandas(probe, schema)


def nearest_neighbours(
    train: DataFrame,
    query: DataFrame,
    features: Sequence[str] = CORE_FEATURES,
    label: str = "ai_label",
    user_col: str = "user_id",
    k: int = 5,
    leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """The ``k`` nearest training raters of every query rater: ``rank``, id, label, squared distance.

    Ids are whole numbers, unique on both sides; rows with an undefined feature take no part.
    Runs a few jobs to build the leaves, then returns a lazy result.
    """
    features = list(features)
    usable = F.lit(True)
    for f in features:
        usable = usable & is_number(f)
    as_double = [F.col(f).cast("double").alias(f) for f in features]
    copies = Window.partitionBy(*features).orderBy("_point")
    points = cut_lineage(
        train.filter(usable)
        .select(F.col(user_col).cast("bigint").alias("_point"), F.col(label).cast("double").alias("_label"), *as_double)
        .withColumn("_copy", F.row_number().over(copies))
        .filter(F.col("_copy") <= k)
        .drop("_copy")
    )
    n_points = points.count()
    wanted = max(1, -(-n_points // leaf_rows))
    depth = int(np.ceil(np.log2(wanted)))
    share = min(_SAMPLE_ROWS, _SAMPLE_PER_LEAF * 2**depth) / max(n_points, 1)
    # A share of the keys, so that the draw needs no sort and every task keeps its own rows.
    sample = points.filter(unit_interval(seeded_key(0, "_point")) < share) if depth else points.limit(1)
    tree = _build_tree(sample.select(*features).toPandas().to_numpy().reshape(-1, len(features)), depth)
    points = _with_leaf(points, features, tree)
    queries = _with_leaf(
        query.filter(usable).select(F.col(user_col).cast("bigint").alias("_query"), *as_double), features, tree
    )
    searched = _search(points, queries, features, k)
    if tree.depth:
        searched = cut_lineage(searched)
        boxes = (
            points.groupBy("_leaf")
            .agg(*[F.min(f).alias(f"lo_{f}") for f in features], *[F.max(f).alias(f"hi_{f}") for f in features])
            .toPandas()
        )
        low = boxes[[f"lo_{f}" for f in features]].to_numpy()
        high = boxes[[f"hi_{f}" for f in features]].to_numpy()
        lows, highs = tree.boxes(boxes["_leaf"].to_numpy(), low, high)
        probes = cut_lineage(_other_leaves(searched, features, k, tree, lows, highs))
        searched = searched.unionByName(_search(points, probes, features, k))
    found = searched.select(
        F.col("_query").alias(user_col),
        F.inline(F.arrays_zip(F.col("_distances"), F.col("_ids"), F.col("_labels"))).alias(
            "distance2", "neighbour", "neighbour_label"
        ),
    )
    best = Window.partitionBy(user_col).orderBy("distance2", "neighbour")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def knn_classify(
    train: DataFrame,
    query: DataFrame,
    features: Sequence[str] = CORE_FEATURES,
    label: str = "ai_label",
    user_col: str = "user_id",
    k: int = 5,
    leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """Share of machine raters among the ``k`` nearest, and the majority class."""
    near = nearest_neighbours(train, query, features, label, user_col, k, leaf_rows)
    scored = near.groupBy(user_col).agg(F.avg("neighbour_label").alias("score"))
    return scored.withColumn("prediction", (F.col("score") > 0.5).cast("double"))
