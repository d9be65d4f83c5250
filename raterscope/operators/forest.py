"""Random forests grown over counts of cells, many trees and folds at a time.

Every feature is cut at quantiles of a fold's training rows into ``bins`` bins, and no tree can tell rows of the same bins apart.
So the training rows of a fold are counted, per class, in the cells of that grid. Counting is one pass over all rows; from
there on the work and everything that is moved depend on cells and trees, never on rows, and a model is one
probability for each cell. A bootstrap draws each row a Poisson number of times; the sum over the rows of a cell is Poisson
too, with the cell's count as its mean, so a tree draws cells.

Trees are independent: Spark spreads them over the tasks, each grows its tree over the occupied cells level by level
(Gini gain, a random part of the features at each node) and adds up what its trees say of every cell. The driver sees these
sums of a fold, which are as many as there are cells.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, intermediate_tables

# Cells of a grid at most; with more, rows are not counted by cells.
_MOST_CELLS = 1 << 17
# Probabilities and shares are added up as whole numbers of this fineness, so that sums do not depend on the order.
_FINE = 2.0**40
# Gains not above this are rounding.
_LEAST_GAIN = 1e-12


@dataclass(frozen=True)
class ForestModel:
    """Cut points of each feature, the probability of class 1 in every cell of their grid, and each feature's importance."""

    features: tuple[str, ...]
    cuts: tuple[tuple[float, ...], ...]
    chances: tuple[float, ...]
    shares: tuple[float, ...]

    def cell(self) -> Column:
        """Number of the cell that a row lies in; what is no number lies above all cuts."""
        found = F.lit(0)
        for feature, cuts in zip(self.features, self.cuts, strict=True):
            value = F.coalesce(F.col(f"`{feature}`").cast("double"), F.lit(math.nan))
            at = F.aggregate(F.lit(list(cuts)), F.lit(0), lambda n, cut: n + (cut <= value).cast("int")) if cuts else F.lit(0)  # noqa: B023
            found = found * (len(cuts) + 1) + at
        return found

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``score``, the probability of class 1, and ``prediction``."""
        table = F.from_json(F.lit(json.dumps(self.chances)), "array<double>")
        return df.withColumn("score", F.get(table, self.cell())).withColumn("prediction", (F.col("score") > 0.5).cast("double"))

    def importance(self) -> dict[str, float]:
        """Share of each feature in the weighted Gini gain of all splits, each tree counting the same."""
        return dict(zip(self.features, self.shares, strict=True))

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, f, list(c), s) for i, (f, c, s) in enumerate(zip(self.features, self.cuts, self.shares, strict=True))]
        grid = spark.createDataFrame(rows, "place int, feature string, cuts array<double>, share double")
        grid.coalesce(1).write.mode("overwrite").parquet(f"{path}/grid")
        cells = spark.createDataFrame(list(enumerate(self.chances)), "cell int, chance double")
        cells.coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")

    @staticmethod
    def load(spark: SparkSession, path: str) -> ForestModel:
        grid = spark.read.parquet(f"{path}/grid").orderBy("place").collect()
        cells = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()
        columns = (tuple(r["feature"] for r in grid), tuple(tuple(r["cuts"]) for r in grid))
        return ForestModel(*columns, tuple(r["chance"] for r in cells), tuple(r["share"] for r in grid))


@dataclass(frozen=True)
class _Grid:
    """What a counting task needs to know: columns of a batch and every fold's cut points."""

    features: tuple[str, ...]
    cuts: Mapping[int, tuple[np.ndarray, ...]]


def _counts(grid: _Grid, cells: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each fold, cell and class (key: place of the fold, cell, class)."""
    sums = np.zeros(len(grid.cuts) * cells * 2, np.int64)
    for batch in batches:
        column = lambda name: batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)
        held_out, label = column("held_out"), column("label").astype(np.int64)
        for place, (fold, cuts) in enumerate(grid.cuts.items()):
            own = held_out == fold
            at = np.full(int(own.sum()), 0, np.int64)
            for feature, borders in zip(grid.features, cuts, strict=True):
                at = at * (len(borders) + 1) + np.searchsorted(borders, column(feature)[own], "right")
            sums += np.bincount((place * cells + at) * 2 + label[own], minlength=len(sums))
    keys = np.flatnonzero(sums)
    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums[keys])], ["key", "rows"])


def _gini(positive: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Gini impurity times the rows, without the factor 2."""
    return np.divide(positive * (rows - positive), rows, out=np.zeros_like(rows), where=rows > 0)


def _tree(bins: np.ndarray, counts: np.ndarray, shape: Sequence[int], depth: int, tried: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Chance of class 1 in every cell under one tree, and each feature's share in its gains.

    ``bins`` and ``counts`` (negative, positive) are of the cells with training rows. A node is a box of the grid.
    """
    n_features, width = len(shape), max(shape)
    drawn = rng.poisson(counts).astype(np.float64)
    every = np.stack(np.unravel_index(np.arange(math.prod(shape)), shape), axis=1)
    node_of, node_of_every = np.zeros(len(bins), np.int64), np.zeros(len(every), np.int64)
    chances, gains = np.zeros(len(every)), np.zeros(n_features)
    n_nodes = 1
    # Cells of nodes that are still open; a closed node's are at -1.
    for level in range(depth + 1):
        inside = node_of >= 0
        where, weights = node_of[inside], drawn[inside]
        sums = np.zeros((2, n_nodes, n_features, width))
        for f in range(n_features):
            key = (where * n_features + f) * width + bins[inside, f]
            for c in range(2):
                sums[c] += np.bincount(key, weights[:, c], sums[c].size).reshape(sums[c].shape) if len(key) else 0.0
        rows, positive = sums.sum(axis=0), sums[1]
        all_rows, all_positive = rows[:, 0].sum(axis=1), positive[:, 0].sum(axis=1)
        low_rows, low_positive = np.cumsum(rows, axis=2)[:, :, :-1], np.cumsum(positive, axis=2)[:, :, :-1]
        high_rows, high_positive = all_rows[:, None, None] - low_rows, all_positive[:, None, None] - low_positive
        gain = _gini(all_positive, all_rows)[:, None, None] - _gini(low_positive, low_rows) - _gini(high_positive, high_rows)
        # As many features as are asked for, drawn anew for each node.
        order = rng.random((n_nodes, n_features)).argsort(axis=1).argsort(axis=1)
        usable = (low_rows > 0) & (high_rows > 0) & (order < tried)[:, :, None]
        gain = np.where(usable, gain, -np.inf).reshape(n_nodes, -1)
        best = gain.argmax(axis=1) if gain.shape[1] else np.zeros(n_nodes, np.int64)
        top = gain[np.arange(n_nodes), best] if gain.shape[1] else np.full(n_nodes, -np.inf)
        splits = (top > _LEAST_GAIN * np.maximum(all_rows, 1.0)) & (level < depth)
        chance = np.divide(all_positive, all_rows, out=np.full(n_nodes, 0.5), where=all_rows > 0)
        feature, cut = np.divmod(best, max(width - 1, 1))
        np.add.at(gains, feature[splits], top[splits])
        child = np.where(splits, 2 * (np.cumsum(splits) - 1), -1)

        def below(at: np.ndarray, of: np.ndarray) -> np.ndarray:
            at = at.copy()
            live = np.flatnonzero(at >= 0)
            node = at[live]
            right = of[live, feature[node]] > cut[node]  # noqa: B023
            at[live] = np.where(splits[node], child[node] + right, -1)  # noqa: B023
            return at

        ending = np.flatnonzero(node_of_every >= 0)
        ending = ending[~splits[node_of_every[ending]]]
        chances[ending] = chance[node_of_every[ending]]
        if not splits.any():
            break
        node_of, node_of_every = below(node_of, bins), below(node_of_every, every)
        n_nodes = 2 * int(splits.sum())
    total = gains.sum()
    return chances, gains / total if total > 0 else gains


def _grown(
    cells: Mapping[int, tuple[np.ndarray, np.ndarray]], shapes: Mapping[int, tuple[int, ...]], depth: int, tried: int, seed: int,
    batches: Iterator[pa.RecordBatch],
) -> Iterator[pa.RecordBatch]:
    """What a task's trees (fold, tree) say together: of each cell of a fold, and behind the cells of each feature."""
    said: dict[int, np.ndarray] = {}
    for batch in batches:
        for row in batch.to_pylist():
            fold = row["fold"]
            at, counts = cells[fold]
            shape = shapes[fold]
            bins = np.stack(np.unravel_index(at, shape), axis=1)
            # The fold and the tree choose the draws, so a tree is the same in whichever task it grows.
            rng = np.random.default_rng([seed, fold + 1, row["tree"]])
            own = np.rint(np.concatenate(_tree(bins, counts, shape, depth, tried, rng)) * _FINE).astype(np.int64)
            said[fold] = said[fold] + own if fold in said else own
    for fold, sums in said.items():
        places = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(places), fold, np.int32)), pa.array(places), pa.array(sums[places])], ["fold", "place", "value"]
        )


@dataclass(frozen=True)
class RandomForest:
    """Parameters. At each node the square root of the number of features, rounded up, is tried.

    ``otherwise`` builds a pipeline where the grid would have too many cells: for more than a few features.
    """

    trees: int
    depth: int
    seed: int
    otherwise: Callable[[str, Sequence[str], int], Pipeline]
    bins: int = 32

    def __call__(self, label: str, features: Sequence[str], n_rows: int) -> Pipeline:
        return self.otherwise(label, features, n_rows)

    def together(self, features: Sequence[str]) -> bool:
        """Whether the rows can be counted by cells."""
        return self.bins ** len(features) <= _MOST_CELLS

    def fit_together(self, rows: DataFrame, features: Sequence[str], folds: Sequence[int], n_rows: int) -> dict[int, ForestModel]:
        """A model for each fold, trained on the rows with ``held_out`` = fold. ``rows`` has ``label`` (0.0 or 1.0), the features and ``held_out``.

        Runs three jobs; its tables are removed.
        """
        with intermediate_tables(rows.sparkSession):
            return self._fitted(rows, tuple(features), tuple(folds))

    def _fitted(self, rows: DataFrame, features: tuple[str, ...], folds: tuple[int, ...]) -> dict[int, ForestModel]:
        spark = rows.sparkSession
        named = [F.col(f"`{f}`").cast("double").alias(f) for f in features]
        rows = cut_lineage(rows.select(F.col("label").cast("double").alias("label"), *named, F.col("held_out").cast("int").alias("held_out")))
        cuts = self._cut_points(rows, features, folds)
        shapes = {fold: tuple(len(c) + 1 for c in own) for fold, own in cuts.items()}
        room = max(math.prod(shape) for shape in shapes.values())
        found = rows.mapInArrow(partial(_counts, _Grid(features, cuts), room), "key long, rows long").groupBy("key").agg(F.sum("rows").alias("rows")).toArrow()
        counts = np.zeros(len(folds) * room * 2, np.int64)
        counts[found.column("key").to_numpy()] = found.column("rows").to_numpy()
        cells = {}
        for fold, own in zip(folds, counts.reshape(len(folds), room, 2), strict=True):
            at = np.flatnonzero(own.any(axis=1))
            cells[fold] = (at, own[at])
        jobs = spark.createDataFrame([(fold, tree) for tree in range(self.trees) for fold in folds], "fold int, tree int")
        spread = jobs.repartition(min(len(folds) * self.trees, 2 * spark.sparkContext.defaultParallelism))
        tried = math.ceil(math.sqrt(len(features)))
        grow = partial(_grown, cells, shapes, self.depth, tried, self.seed)
        said = spread.mapInArrow(grow, "fold int, place long, value long").groupBy("fold", "place").agg(F.sum("value").alias("value")).toArrow()
        fold_of, place, value = (said.column(c).to_numpy() for c in ("fold", "place", "value"))
        models = {}
        for fold in folds:
            own = fold_of == fold
            n_cells = math.prod(shapes[fold])
            sums = np.zeros(n_cells + len(features))
            sums[place[own]] = value[own] / _FINE
            shares = sums[n_cells:]
            shares = shares / shares.sum() if shares.sum() > 0 else shares
            models[fold] = ForestModel(
                features, tuple(tuple(map(float, c)) for c in cuts[fold]), tuple(map(float, sums[:n_cells] / self.trees)), tuple(map(float, shares))
            )
        return models

    def _cut_points(self, rows: DataFrame, features: Sequence[str], folds: Sequence[int]) -> dict[int, tuple[np.ndarray, ...]]:
        """Of each fold, ascending quantiles of its training rows' features, each a value that occurs. Runs a job."""
        shares = [i / self.bins for i in range(self.bins)]
        aggregates = [F.percentile_approx(f"`{f}`", shares, 100 * self.bins).alias(f"q{i}") for i, f in enumerate(features)]
        found = {r["held_out"]: r for r in rows.groupBy("held_out").agg(*aggregates).collect()}

        def borders(fold: int, i: int) -> np.ndarray:
            values = (found[fold][f"q{i}"] if fold in found else None) or []
            # Nothing lies below the least value.
            return np.unique(np.array(values, np.float64))[1:]

        return {fold: tuple(borders(fold, i) for i in range(len(features))) for fold in folds}
