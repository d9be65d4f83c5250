"""Boosted trees with L1 and L2 penalties, many models at a time.

All models of a cross-validation or a learning curve grow together, level by level: one job a level adds up,
for every second open node of every model, the first and second derivatives of the log loss over the bins of each feature; its
sibling's are what is left of the parent's. Tasks sum their rows' histograms before they are grouped, so what is moved depends
on models, nodes and bins, never on rows; the histograms are the only thing that the driver sees, and their size is a parameter's.
Rows come with the models that they train as the fold held out (``held_out``) and the first step that uses them
(``first_step``). They are binned once and held in blocks of arrays, each row once for every model it trains, with
its margin, which each round renews where it is kept; a job walks the tree that grows, not those before it. A block is of one
model. Blocks lie in the order of their models, in equal parts, so a task knows few models and sends few histograms,
and a model with many rows has many tasks.

A split's gain is ``S(left) + S(right) - S(whole)`` with ``S = soft(G, l1)^2 / (H + l2)``, and a leaf's value
``-rate * soft(G, l1) / (H + l2)``. Derivatives are summed as whole numbers, scaled so that all rows
together stay below 2^53: sums, and so splits, do not depend on partitions, order or retries. Cut points are quantiles of the
whole table; labels play no part in them.

A fitted model is a table of nodes. It scores as one native expression that meets every tree's leaves as bits, and knows the gain of each split.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CORE_FEATURES
from ..session import cut_lineage, intermediate_tables

# Gains not above this are rounding.
_LEAST_GAIN = 1e-6
# Rounds between two tables of margins; the rounds between keep theirs with the executors.
_WRITTEN_EVERY = 10
# Rows, counted once for each model that they train: packed at a time, of a block, and of a partition at least and at most.
_PACKED_ROWS, _BLOCK_ROWS = 400_000, 50_000
_LEAST_ROWS, _MOST_ROWS = 50_000, 4_000_000
# Rows scored at a time.
_SCORED_ROWS = 40_000
# Sums of all tasks that the driver adds up itself.
_CELLS_COLLECTED = 4_000_000
# Leaves that a word of bits tells apart when a row is scored.
_WORD = 64
# Least second derivative of a row, so that a sure row still has weight.
_LEAST_CURVE = 1e-16

_BLOCKS = "target int, model int, label binary, bins binary, margin binary"
_LEDGER = "tree int, node int, feature string, cut double, left int, value double, gain double, cover double"


@dataclass(frozen=True)
class BoostedModel:
    """Trees as nodes (tree, node, feature or null, cut, left child, value, gain, cover); the right child follows the left."""

    features: tuple[str, ...]
    nodes: tuple[tuple, ...]

    def ledger(self, spark: SparkSession) -> DataFrame:
        """One row for each node. Splits have a feature, a cut (left below it) and a gain, leaves a value."""
        return spark.createDataFrame(list(self.nodes), _LEDGER)

    def margin(self) -> Column:
        """The sum of the leaves that a row falls into, as one expression over the feature columns.

        No tree is walked. A bit for each leaf of a tree tells, for a bin of a feature, whether rows of that bin can fall into it;
        of what all features leave, one bit is the row's leaf. A row costs a few steps a tree, whatever the trees' depth.
        """
        cuts, masks, values = _leaf_masks(self)
        # What is no number lies above all cuts.
        row = [F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(math.nan)) for f in self.features]
        table = F.from_json(F.lit(json.dumps(masks)), "array<array<array<bigint>>>")
        left = [F.get(F.get(table, F.lit(i)), _bin_of(x, c)) for i, (x, c) in enumerate(zip(row, cuts, strict=True))]

        def leaf(bits: Column, own: Column) -> Column:
            return F.get(own, F.when(bits < 0, _WORD - 1).otherwise(F.bit_count(bits - 1)))

        bits = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x.bitwiseAND(y)), left)
        leaves = F.zip_with(bits, F.from_json(F.lit(json.dumps(values)), "array<array<double>>"), leaf)
        return F.aggregate(leaves, F.lit(0.0), lambda total, value: total + value)

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``score``, the probability of class 1, and ``prediction``."""
        score = F.lit(1.0) / (F.lit(1.0) + F.exp(-self.margin()))
        return df.withColumn("score", score).withColumn("prediction", (F.col("score") > 0.5).cast("double"))

    def importance(self) -> dict[str, float]:
        """Mean gain of each feature's splits, as a share of all features'."""
        gains: dict[str, list[float]] = {f: [] for f in self.features}
        for _, _, feature, _, _, _, gain, _ in self.nodes:
            if feature is not None:
                gains[feature].append(gain)
        means = {f: sum(g) / len(g) if g else 0.0 for f, g in gains.items()}
        total = sum(means.values())
        return {f: m / total if total else 0.0 for f, m in means.items()}

    def save(self, spark: SparkSession, path: str) -> None:
        self.ledger(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        names = spark.createDataFrame(list(enumerate(self.features)), "place int, feature string")
        names.coalesce(1).write.mode("overwrite").parquet(f"{path}/features")

    @staticmethod
    def load(spark: SparkSession, path: str) -> BoostedModel:
        names = spark.read.parquet(f"{path}/features").orderBy("place").collect()
        nodes = spark.read.parquet(f"{path}/nodes").orderBy("tree", "node").collect()
        return BoostedModel(tuple(r["feature"] for r in names), tuple(tuple(r) for r in nodes))


def _bin_of(value: Column, cuts: Sequence[float]) -> Column:
    """Number of cuts (ascending) at or below the value, by halving steps."""
    if not cuts:
        return F.lit(0)
    steps = [1 << i for i in reversed(range(len(cuts).bit_length()))]
    table = F.from_json(F.lit(json.dumps(cuts)), "array<double>")
    # Behind the last cut there is null, which is not at or below anything.
    return F.aggregate(F.lit(steps), F.lit(0), lambda at, step: F.when(F.get(table, at + step - 1) <= value, at + step).otherwise(at))


def _leaf_masks(model: BoostedModel) -> tuple[list[list[float]], list, list]:
    """Of each feature its cuts and, by bin and word, the leaves that rows of the bin can fall into; of each word its leaves' values.

    A word holds up to 64 leaves of a tree, a bit each; a larger tree has several. Behind a word's values is 0, for rows that fall into none of them.
    """
    cuts = [sorted({n[3] for n in model.nodes if n[2] == f}) for f in model.features]
    place = {(f, cut): i for f, own in zip(model.features, cuts, strict=True) for i, cut in enumerate(own)}
    trees: dict[int, dict[int, tuple]] = {}
    for node in model.nodes:
        trees.setdefault(node[0], {})[node[1]] = node
    boxes, values = [], []
    for nodes in trees.values():
        todo, held = [(0, {f: (0, len(own) + 1) for f, own in zip(model.features, cuts, strict=True)})], _WORD
        while todo:
            at, box = todo.pop()
            _, _, feature, cut, left, value, _, _ = nodes[at]
            if feature is not None:
                low, high = box[feature]
                border = min(max(place[feature, cut] + 1, low), high)
                todo += [(left, box | {feature: (low, border)}), (left + 1, box | {feature: (border, high)})]
                continue
            if held == _WORD:
                values.append([0.0] * (_WORD + 1))
                held = 0
            values[-1][held] = value
            boxes.append((len(values) - 1, np.uint64(1 << held), box))
            held += 1
    masks = [np.zeros((len(own) + 1, len(values)), np.uint64) for own in cuts]
    for word, bit, box in boxes:
        for own, feature in zip(masks, model.features, strict=True):
            low, high = box[feature]
            own[low:high, word] |= bit
    return cuts, [own.view(np.int64).tolist() for own in masks], values


def _depth(features: list[int], left: list[int]) -> int:
    deep, depth = [0] * len(features), 0
    for i, feature in enumerate(features):  # children come after their parent
        if feature >= 0:
            deep[left[i]] = deep[left[i] + 1] = deep[i] + 1
            depth = max(depth, deep[i] + 1)
    return depth


@dataclass
class _Trees:
    """A tree of each model, as a complete binary tree of node places."""

    n_models: int
    n_nodes: int
    feature: np.ndarray = field(init=False)
    cut: np.ndarray = field(init=False)
    value: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        shape = self.n_models, self.n_nodes
        # No bin lies above the cut of a node that does not split.
        self.feature, self.cut, self.value = np.full(shape, -1, np.int16), np.full(shape, np.iinfo(np.int32).max, np.int32), np.zeros(shape)

    def place(self, bins: np.ndarray, model: int, levels: int) -> np.ndarray:
        """Place of each row (bins by feature) ``levels`` below the root of a model's tree; below a leaf rows go left."""
        flat, rows, cut = bins.ravel(), np.arange(bins.shape[1]), self.cut[model]
        start = np.maximum(self.feature[model], 0) * np.int64(bins.shape[1])
        at = np.zeros(bins.shape[1], np.int64)
        for _ in range(levels):
            own = start.take(at)
            own += rows
            right = flat.take(own) > cut.take(at)
            at *= 2
            at += 1
            at += right
        return at

    def settle(self) -> None:
        """Carry the leaves' values down to where ``place`` leaves their rows."""
        for at in range(self.n_nodes // 2):
            closed = self.feature[:, at] < 0
            self.value[closed, 2 * at + 1] = self.value[closed, at]

    def leaf(self, bins: np.ndarray, model: int) -> np.ndarray:
        """Value of the leaf that each row falls into, once settled."""
        return self.value[model].take(self.place(bins, model, self.n_nodes.bit_length() - 1))


@dataclass(frozen=True)
class _Plan:
    """What a task needs to know: columns of a batch, cut points, models."""

    features: tuple[str, ...]
    cuts: tuple[np.ndarray, ...]
    held_out: np.ndarray
    steps: int
    scale: float

    @property
    def n_bins(self) -> int:
        return max(len(c) for c in self.cuts) + 1

    @property
    def bin_type(self) -> type:
        return np.uint8 if self.n_bins <= 256 else np.uint32

    def read(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each row and each step that uses it: the row's place in the batch, label, bins and model."""
        column = lambda name: batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)
        bins = np.stack([np.searchsorted(c, column(f), "right") for f, c in zip(self.features, self.cuts, strict=True)], axis=1)
        order = np.argsort(self.held_out)
        fold = order[np.searchsorted(self.held_out, column("held_out"), sorter=order)]
        row, step = np.nonzero(column("first_step")[:, None] <= np.arange(1, self.steps + 1))
        return row, column("label")[row], bins.astype(self.bin_type)[row], (fold[row] * self.steps + step).astype(np.int32)

# A model's rows: the model, labels, bins by feature, margins.
_Block = tuple[int, np.ndarray, np.ndarray, np.ndarray]


def _packed_rows(plan: _Plan, ends: np.ndarray, partitions: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row once for every model that it trains, in blocks of one model and one target partition.

    ``ends`` counts the rows of the models up to each; the line of all of them is cut into equal parts.
    """
    waiting, held = [], 0
    borders = np.arange(partitions + 1) * (ends[-1] / partitions)

    def blocks() -> Iterator[pa.RecordBatch]:
        label, bins, model = (np.concatenate(c) for c in zip(*waiting, strict=True))
        order = np.argsort(model, kind="stable")
        found, first = np.unique(model[order], return_index=True)
        for m, rows in zip(found.tolist(), np.split(order, first[1:]), strict=True):
            start = ends[m - 1] if m else 0
            # The model's rows are shared out as its stretch of the line is.
            cuts = np.rint(np.clip((borders - start) / (ends[m] - start), 0, 1) * len(rows)).astype(int)
            for target in np.flatnonzero(np.diff(cuts)).tolist():
                own = rows[cuts[target] : cuts[target + 1]]
                arrays = label[own], np.ascontiguousarray(bins[own].T), np.zeros(len(own))
                columns = [pa.array([target], pa.int32()), pa.array([m], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in arrays)]
                yield pa.RecordBatch.from_arrays(columns, ["target", "model", "label", "bins", "margin"])

    for batch in batches:
        _, label, bins, model = plan.read(batch)
        waiting.append((label.astype(np.uint8), bins, model))
        held += len(label)
        if held >= _PACKED_ROWS:
            yield from blocks()
            waiting, held = [], 0
    if held:
        yield from blocks()


def _merged(plan: _Plan, rows: Iterator) -> Iterator[_Block]:
    """Rows of the table of blocks as arrays, small blocks of a model joined."""
    waiting: dict[int, list] = {}
    for row in rows:
        label, margin = np.frombuffer(row["label"], np.uint8), np.frombuffer(row["margin"], np.float64)
        own = waiting.setdefault(row["model"], [])
        own.append((label, np.frombuffer(row["bins"], plan.bin_type).reshape(len(plan.features), -1), margin))
        if sum(len(x[0]) for x in own) >= _BLOCK_ROWS:
            yield _joined(row["model"], waiting.pop(row["model"]))
    for model, own in waiting.items():
        yield _joined(model, own)


def _joined(model: int, parts: list) -> _Block:
    label, bins, margin = zip(*parts, strict=True)
    return model, np.concatenate(label), np.concatenate(bins, axis=1), np.concatenate(margin)


def _histograms(plan: _Plan, trees: _Trees, slots: np.ndarray, levels: int, blocks: Iterator[_Block]) -> Iterator[tuple[int, np.ndarray]]:
    """Of each model its sums of scaled derivatives (node, slope or curve, feature, bin) for the wanted nodes (``slots``: model, node -> place or -1)."""
    n_features, n_bins = len(plan.features), plan.n_bins
    found: dict[int, np.ndarray] = {}
    for model, label, bins, margin in blocks:
        n_slots = int(slots[model].max()) + 1
        if not n_slots:
            continue
        slot = slots[model].take(trees.place(bins, model, levels))
        wanted = np.flatnonzero(slot >= 0)
        chance = 1 / (1 + np.exp(-margin[wanted]))
        slope = np.rint((chance - label[wanted]) * plan.scale)
        curve = np.rint(np.maximum(chance * (1 - chance), _LEAST_CURVE) * plan.scale)
        base = slot[wanted] * n_bins
        if model not in found:
            found[model] = np.zeros((2, n_features, n_slots * n_bins))
        sums = found[model]
        for i in range(n_features):
            key = base + bins[i].take(wanted)
            sums[0, i] += np.bincount(key, slope, n_slots * n_bins)
            sums[1, i] += np.bincount(key, curve, n_slots * n_bins)
    for model, sums in found.items():
        yield model, np.ascontiguousarray(sums.reshape(2, n_features, -1, n_bins).transpose(2, 0, 1, 3))


def _grown_margins(trees: _Trees, block: _Block) -> _Block:
    model, label, bins, margin = block
    return model, label, bins, margin + trees.leaf(bins, model)


def _as_row(block: _Block) -> tuple:
    model, *arrays = block
    return 0, model, *(a.tobytes() for a in arrays)


def _scores(plan: _Plan, forest: Sequence[_Trees], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _larger(batches):
        row, label, bins, model = plan.read(batch)
        margin, order = np.zeros(len(row)), np.argsort(model, kind="stable")
        found, first = np.unique(model[order], return_index=True)
        for m, own in zip(found.tolist(), np.split(order, first[1:]), strict=True):
            walked, total = np.ascontiguousarray(bins[own].T), np.zeros(len(own))
            for trees in forest:
                total += trees.leaf(walked, m)
            margin[own] = total
        take = lambda name: batch.column(batch.schema.get_field_index(name)).take(pa.array(row))
        yield pa.RecordBatch.from_arrays(
            [pa.array(model % plan.steps + 1, pa.int32()), take("part"), take("held_out"), pa.array(label), pa.array(1 / (1 + np.exp(-margin)))],
            ["step", "part", "fold", "label", "score"],
        )


def _larger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about as many rows as are scored at a time."""
    waiting, held = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        waiting.append(batch)
        held += batch.num_rows
        if held >= _SCORED_ROWS:
            yield pa.concat_batches(waiting)
            waiting, held = [], 0
    if waiting:
        yield pa.concat_batches(waiting)


@dataclass(frozen=True)
class BoostedTrees:
    """Parameters. ``least_cover`` is the least sum of second derivatives on either side of a split."""

    rounds: int = 100
    depth: int = 6
    rate: float = 0.3
    l1: float = 0.1
    l2: float = 1.0
    least_cover: float = 1.0
    bins: int = 256

    def cut_points(self, rows: DataFrame, features: Sequence[str]) -> list[np.ndarray]:
        """Ascending quantiles of each feature, each a value that occurs. Runs a job."""
        shares = [i / self.bins for i in range(self.bins)]
        found = rows.agg(*[F.percentile_approx(f"`{f}`", shares, 100 * self.bins).alias(f"q{i}") for i, f in enumerate(features)]).first()
        # Nothing lies below the least value, so it divides nothing; it only stands in for no cut at all.
        cuts = [np.unique(np.array(found[i] or [0.0], np.float64)) for i in range(len(features))]
        return [c[1:] if len(c) > 1 else c for c in cuts]

    def fit_together(self, rows: DataFrame, features: Sequence[str], folds: Sequence[int], n_rows: int) -> dict[int, BoostedModel]:
        """A model for each fold, trained on the rows with ``held_out`` = fold."""
        models = self.fit_many(rows.withColumn("first_step", F.lit(1)), features, folds, 1, n_rows)
        return {fold: model for (fold, _), model in models.items()}

    def fit_many(
        self, rows: DataFrame, features: Sequence[str], held_out: Sequence[int], steps: int, n_rows: int
    ) -> dict[tuple[int, int], BoostedModel]:
        """A model for each fold and step, trained on the rows of ``held_out`` = fold and ``first_step`` <= step.

        ``rows`` has ``label`` (0.0 or 1.0), the features, ``held_out`` and ``first_step``; ``n_rows`` bounds the rows of a
        model. Runs one job for each level of each round and one for every ten rounds; its tables are removed.
        """
        with intermediate_tables(rows.sparkSession):
            return self._grown(rows, features, held_out, steps, n_rows)

    def _grown(self, rows, features, held_out, steps, n_rows) -> dict[tuple[int, int], BoostedModel]:
        n_models, n_nodes = len(held_out) * steps, 2 ** (self.depth + 1) - 1
        scale = 2.0 ** (52 - max(int(n_rows), 1).bit_length())
        plan = _Plan(tuple(features), tuple(self.cut_points(rows, features)), np.array(held_out, np.int64), steps, scale)
        named = [F.col(f"`{f}`").cast("double").alias(f) for f in features]
        kinds = [F.col("held_out").cast("int").alias("held_out"), F.col("first_step").cast("int").alias("first_step")]
        narrow = rows.select(F.col("label").cast("double").alias("label"), *named, *kinds)
        partitions = _partitions(rows.sparkSession, n_rows * n_models)
        pack = partial(_packed_rows, plan, _ends(narrow, held_out, steps), partitions)
        packed = narrow.repartition(partitions).mapInArrow(pack, _BLOCKS)
        current = _kept(plan, packed.repartitionById(partitions, F.col("target")))
        ledgers: list[list[tuple]] = [[] for _ in range(n_models)]
        try:
            for round_ in range(self.rounds):
                before = None
                if round_:
                    # The first level's job keeps the new margins where the old ones were kept.
                    before, current = current, current.map(partial(_grown_margins, trees))
                    if round_ % _WRITTEN_EVERY == 0:
                        current = _kept(plan, rows.sparkSession.createDataFrame(current.map(_as_row), _BLOCKS, verifySchema=False))
                    current = current.persist(StorageLevel.MEMORY_AND_DISK)
                trees = _Trees(n_models, n_nodes)
                gains, covers = np.zeros((n_models, n_nodes)), np.zeros((n_models, n_nodes))
                wanted, above = np.array([[model, 0] for model in range(n_models)]), None
                for level in range(max(self.depth, 1)):
                    wanted, above = self._level(plan, trees, current, level, wanted, above, gains, covers)
                    if before is not None:
                        before.unpersist()
                        before = None
                    if not len(wanted):
                        break
                trees.settle()
                for model, ledger in enumerate(ledgers):
                    ledger += _nodes(plan, trees, model, round_, gains[model], covers[model])
        finally:
            current.unpersist()
        return {
            (fold, step + 1): BoostedModel(tuple(features), tuple(ledgers[i * steps + step]))
            for i, fold in enumerate(held_out)
            for step in range(steps)
        }

    def _sums(self, plan: _Plan, trees: _Trees, rows: RDD, level: int, wanted: np.ndarray) -> np.ndarray:
        """Histograms (node, slope or curve, feature, bin) of the wanted nodes (model, node), in scaled whole numbers. Runs a job.

        The wanted nodes lie in the order of their models.
        """
        found, first, own = np.unique(wanted[:, 0], return_index=True, return_counts=True)
        start = dict(zip(found.tolist(), first.tolist(), strict=True))
        slots = np.full(trees.feature.shape, -1, np.int64)
        slots[tuple(wanted.T)] = np.arange(len(wanted)) - np.repeat(first, own)
        sums = rows.mapPartitions(partial(_histograms, plan, trees, slots, level))
        # Few sums are added here, many by Spark first. Where parts meet, two tasks know a model.
        cells = len(plan.features) * plan.n_bins
        if (len(wanted) + rows.getNumPartitions() * int(own.max())) * cells > _CELLS_COLLECTED:
            sums = sums.reduceByKey(np.add, min(len(found), rows.getNumPartitions()))
        exact = np.zeros((len(wanted), 2, len(plan.features), plan.n_bins))
        for model, part in sums.collect():
            exact[start[model] : start[model] + len(part)] += part
        return exact

    def _level(self, plan, trees, rows, level, open_, above, gains, covers) -> tuple[np.ndarray, tuple | None]:
        """Split the open nodes (model, node) or make leaves of them; returns the nodes that are open next, and what is known of them.

        Of two children only the one with less weight is summed; the other's sums are what is left of the parent's (``above``). Runs a job.
        """
        if above is None:
            exact = self._sums(plan, trees, rows, level, open_)
        else:
            whole, lesser = above
            exact = np.empty((len(open_), *whole.shape[1:]))
            asked = 2 * np.arange(len(lesser)) + lesser
            exact[asked] = self._sums(plan, trees, rows, level, open_[asked])
            exact[asked + 1 - 2 * lesser] = whole - exact[asked]
        dense = exact.swapaxes(0, 1) / plan.scale
        n_bins = plan.n_bins
        whole = dense[:, :, 0].sum(axis=2)
        left = np.cumsum(dense, axis=3)[:, :, :, :-1]
        right = whole[:, :, None, None] - left
        gain = self._worth(*left) + self._worth(*right) - self._worth(*whole)[:, None, None]
        real = np.arange(n_bins - 1) < np.array([len(c) for c in plan.cuts])[:, None]
        allowed = (left[1] >= self.least_cover) & (right[1] >= self.least_cover) & real
        gain = np.where(allowed, gain, -np.inf).reshape(len(gain), -1)
        best = gain.argmax(axis=1)  # the first feature and cut on ties
        top = gain[np.arange(len(gain)), best]
        following, split, lesser = [], [], []
        for slot, (model, node) in enumerate(open_.tolist()):
            covers[model, node] = whole[1, slot]
            deepest = 2 * node + 2 >= trees.n_nodes
            if deepest or not top[slot] > _LEAST_GAIN:
                trees.value[model, node] = self._leaf(whole[0, slot], whole[1, slot])
                continue
            feature, cut = divmod(int(best[slot]), n_bins - 1)
            trees.feature[model, node], trees.cut[model, node] = feature, cut
            gains[model, node] = top[slot]
            children = [2 * node + 1, 2 * node + 2]
            if 2 * children[1] + 2 < trees.n_nodes:
                following += [(model, child) for child in children]
                split.append(slot)
                lesser.append(int(right[1, slot, feature, cut] < left[1, slot, feature, cut]))
                continue
            # The last level: its sums are known, so no job is needed for it.
            for child, side in zip(children, (left, right), strict=True):
                slope, curve = side[:, slot, feature, cut]
                covers[model, child] = curve
                trees.value[model, child] = self._leaf(slope, curve)
        return np.array(following, np.int64).reshape(-1, 2), (exact[split], np.array(lesser, np.int64))

    def _soft(self, slope):
        return np.sign(slope) * np.maximum(np.abs(slope) - self.l1, 0.0)

    def _worth(self, slope, curve):
        return self._soft(slope) ** 2 / (curve + self.l2)

    def _leaf(self, slope, curve) -> float:
        return float(-self.rate * self._soft(slope) / (curve + self.l2))


def _partitions(spark: SparkSession, n_rows: int) -> int:
    """Partitions for ``n_rows`` rows, each counted once for every model: all cores, if that is work enough for them, or several times as many."""
    cores = spark.sparkContext.defaultParallelism
    few = min(cores, -(-n_rows // _LEAST_ROWS))
    return max(1, few, -(-n_rows // (_MOST_ROWS * cores)) * cores if n_rows > _MOST_ROWS * cores else 1)


def _ends(rows: DataFrame, held_out: Sequence[int], steps: int) -> np.ndarray:
    """How many rows the models up to each train on. Runs a job."""
    own = np.zeros((len(held_out), steps), np.int64)
    for fold, step, n in rows.groupBy("held_out", "first_step").count().collect():
        if fold in held_out and step is not None:
            own[list(held_out).index(fold), max(step, 1) - 1 :] += n
    return np.cumsum(own.ravel())


def _kept(plan: _Plan, blocks: DataFrame) -> RDD:
    """The blocks, written once, as arrays that stay with the executors."""
    return cut_lineage(blocks).rdd.mapPartitions(partial(_merged, plan)).persist(StorageLevel.MEMORY_AND_DISK)


def _nodes(plan: _Plan, trees: _Trees, model: int, tree: int, gains: np.ndarray, covers: np.ndarray) -> list[tuple]:
    """Rows of the ledger for one tree: its nodes from the root down, numbered as they come."""
    features, cuts, values = (t[model] for t in (trees.feature, trees.cut, trees.value))
    places, found = [0], []
    for at in places:
        if features[at] < 0:
            found.append((tree, len(found), None, None, None, float(values[at]), None, float(covers[at])))
            continue
        feature = int(features[at])
        cut = float(plan.cuts[feature][cuts[at]])
        found.append((tree, len(found), plan.features[feature], cut, len(places), 0.0, float(gains[at]), float(covers[at])))
        places += [2 * at + 1, 2 * at + 2]
    return found


def _packed(models: Mapping[tuple[int, int], BoostedModel], features: Sequence[str], held_out: Sequence[int], steps: int) -> tuple[_Plan, list[_Trees]]:
    """Fitted models as arrays for one task's walk over all of them."""
    cuts = [np.unique([n[3] for m in models.values() for n in m.nodes if n[2] == f] or [0.0]) for f in features]
    plan = _Plan(tuple(features), tuple(cuts), np.array(held_out, np.int64), steps, 1.0)
    grown: dict[int, list[tuple[int, dict[int, tuple]]]] = {}
    for i, fold in enumerate(held_out):
        for step in range(1, steps + 1):
            own: dict[int, dict[int, tuple]] = {}
            for tree, node, feature, cut, left, value, _, _ in models[fold, step].nodes:
                own.setdefault(tree, {})[node] = (feature, cut, left, value)
            for tree, nodes in own.items():
                grown.setdefault(tree, []).append((i * steps + step - 1, nodes))
    forest = []
    for _, alike in sorted(grown.items()):
        depth = 0
        for _, nodes in alike:
            order = sorted(nodes)
            depth = max(depth, _depth([-1 if nodes[n][0] is None else 0 for n in order], [nodes[n][2] or 0 for n in order]))
        trees = _Trees(len(held_out) * steps, 2 ** (depth + 1) - 1)
        for row, nodes in alike:
            todo = [(0, 0)]
            while todo:
                node, at = todo.pop()
                feature, cut, left, value = nodes[node]
                if feature is None:
                    trees.value[row, at] = value
                    continue
                j = list(features).index(feature)
                trees.feature[row, at] = j
                trees.cut[row, at] = int(np.searchsorted(cuts[j], cut))
                todo += [(left, 2 * at + 1), (left + 1, 2 * at + 2)]
        trees.settle()
        forest.append(trees)
    return plan, forest


def score_many(rows: DataFrame, models: Mapping[tuple[int, int], BoostedModel], features: Sequence[str] = CORE_FEATURES) -> DataFrame:
    """``step``, ``part``, ``fold``, ``label`` and ``score`` of each row under the models of its ``held_out`` fold from its ``first_step`` on.

    One pass over the rows for all models, dealt to all cores.
    """
    held_out, steps = sorted({f for f, _ in models}), max(s for _, s in models)
    plan, forest = _packed(models, features, held_out, steps)
    named = [F.col(f"`{f}`").cast("double").alias(f) for f in features]
    kinds = [F.col(c).cast("int").alias(c) for c in ("held_out", "first_step")]
    narrow = rows.select(F.col("label").cast("double").alias("label"), *named, *kinds, "part")
    # A row costs much: no core should be without rows.
    spread = narrow.repartition(max(narrow.rdd.getNumPartitions(), rows.sparkSession.sparkContext.defaultParallelism))
    return spread.mapInArrow(partial(_scores, plan, forest), "step int, part string, fold int, label double, score double")
