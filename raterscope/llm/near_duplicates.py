"""Similarity join of documents by the Jaccard similarity of their word n-grams, with count-vector R-trees.

A document is its set of hashed n-grams. The hashes are dealt into ``GROUPS`` groups; the counts per group are
a point. For two points the sum of coordinate minima bounds the overlap of the sets from above, and
so does the sum with the upper corner of a box for every point in the box. An R-tree of such boxes is
probed with each document; boxes and then points whose bound is below the overlap that the threshold
asks for are passed over, and only surviving pairs are verified on the sets.

One tree over all documents would have to live somewhere, and its boxes say little far from the leaves.
So there are many: documents that could be linked are brought together in families first.

1. Equal sets are one node from the start: copies cost a narrow row each.
2. A set of n n-grams can only reach the threshold with sets that share one of its first
   ``n - required overlap + 1`` n-grams, in any order that is the same for all. The order here is by
   rarity among the n-grams of the lowest hashes, and then by hash, so that
   passages in very many documents come last and link next to nobody. Those that a small sample
   shows to be popular come last uncounted: every task knows them, so a node is joined to the first of those in
   its prefix, and these to each other in a chain, and no task gathers their nodes.
3. Nodes that share such an n-gram are one family (connected components of a star at each n-gram).
   A link cannot cross families.
4. Families are searched in blocks of bounded size. First every block of a family is searched
   together with one anchor of the family; where that leaves the family in several parts, all
   blocks outside its largest part meet all blocks of comparable size. So a large group of near copies
   needs about one pass over it, and no pair of different parts goes unseen.

Results are components: pairs within a component are verified until it hangs together, not listed.

Defined results: null and empty texts have no n-grams and are linked with nothing; a text of fewer words
than n has its whole sequence as one; rows with equal ids are judged by their own texts; a row with a null id
is linked as its text is, but names no component; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .components import Forest, connected_components
from .shingles import shingle_sets
from .text import byte_texts, slices

GROUPS = 64
# Points of a leaf of the tree.
_LEAF = 16
# Nodes of a block: what a task holds of a family at a time.
BLOCK = 128
# Rows of the sample that tells which n-grams are popular.
SAMPLE_ROWS = 4000
# Popular n-grams that are sent to every task at most.
POPULAR = 1_000_000
# Rows of block, node, side and id (some 40 bytes each) that are sent to every executor at most.
SENT_ROWS = 500_000
_SLICE_BYTES = 1 << 20


def required_overlap(sizes, percent: int):
    """Least overlap of two sets, of ``sizes`` together, at which 100 * overlap >= percent * union."""
    return -(-percent * sizes // (100 + percent))


def _prefix_length(n, percent: int):
    return n - -(-percent * n // 100) + 1


def _low_share(percent: int) -> float:
    """Share of the hash range whose n-grams are counted: enough rare ones to fill a prefix."""
    return min(1.0, 1.5 * (100 - percent) / 100 + 0.1)


def _node(own: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(own.tobytes(), seed=len(own)) - (1 << 63)


def _candidates(own: np.ndarray, percent: int) -> np.ndarray:
    """The n-grams of a set that may stand in its prefix: those of the lowest hashes."""
    limit = np.uint64(min(int(_low_share(percent) * 2**64), 2**64 - 1))
    return own[: max(_prefix_length(len(own), percent), int(np.searchsorted(own, limit)))]


class _Once:
    """Tells what a task meets for the first time, as far as it remembers; the shuffle finds the rest."""

    def __init__(self, most: int = 100_000):
        self.seen: set = set()
        self.most = most

    def __call__(self, value) -> bool:
        if value in self.seen:
            return False
        if len(self.seen) >= self.most:
            self.seen.clear()
        self.seen.add(value)
        return True


def _sets(width: int, percent: int, share: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, set size, node (hash of the set); and for a share of the nodes the n-grams that may stand in its prefix."""
    border, fresh = int(share * (1 << 30)), _Once()
    for batch in slices(batches, "text", _SLICE_BYTES):
        values, offsets = shingle_sets(byte_texts(batch.column(1)), width)
        sizes, nodes, grams = [], [], []
        for begin, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            own = values[begin:end]
            sizes.append(end - begin)
            nodes.append(_node(own) if len(own) else None)
            drawn = len(own) and nodes[-1] % (1 << 30) < border and fresh(nodes[-1])
            grams.append(_candidates(own, percent).view(np.int64) if drawn else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(grams, pa.list_(pa.int64()))],
            ["id", "n", "node", "grams"],
        )


# What a row of ``_prefixes`` says: a rare n-gram (key) may stand in the prefix of a node (value); two vertices,
# nodes or popular n-grams, belong to one family; a node's prefix has room for so many more than its rare n-grams.
_RARE, _EDGE, _ROOM = 0, 1, 2


def _prefixes(width: int, percent: int, popular: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Key, value and kind for every set.

    Popular n-grams come last in the order, so how many of them the prefix takes in is known here. They
    are joined in a chain, and the node to the first of them: the chain says as much as an edge to each.
    """
    fresh, fresh_edge = _Once(), _Once(1_000_000)
    for batch in slices(batches, "text", _SLICE_BYTES):
        values, offsets = shingle_sets(byte_texts(batch.column(0)), width)
        keys, others, edges, rooms = [], [], [], []
        for begin, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            own = values[begin:end]
            if not len(own) or not fresh(node := _node(own)):
                continue
            grams = _candidates(own, percent)
            if len(popular):
                at = np.minimum(np.searchsorted(popular, grams), len(popular) - 1)
                known = popular[at] == grams
                rare, common = grams[~known], grams[known]
            else:
                rare, common = grams, grams[:0]
            room = _prefix_length(len(own), percent) - len(rare)
            chain = [node, *common[: max(room, 0)].view(np.int64).tolist()]
            edges += [edge for edge in zip(chain, chain[1:]) if fresh_edge(edge)]
            rooms.append((node, room))
            keys.append(rare.view(np.int64))
            others.append(np.full(len(rare), node, np.int64))
        counts = [sum(map(len, keys)), len(edges), len(rooms)]
        pairs = np.array(edges + rooms, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([*keys, pairs[:, 0]])),
                pa.array(np.concatenate([*others, pairs[:, 1]])),
                pa.array(np.repeat(np.array([_RARE, _EDGE, _ROOM], np.int8), counts)),
            ],
            ["key", "value", "kind"],
        )


class CountTree:
    """R-tree of count vectors, packed in order of set size: two levels of boxes above the points."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent = percent
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.points = np.stack([np.bincount((s >> np.uint64(58)).astype(np.int64), minlength=GROUPS) for s in sets])
        order = np.argsort(self.sizes, kind="stable")
        self.leaves = [order[i : i + _LEAF] for i in range(0, len(order), _LEAF)]
        # A box's bound needs its upper corner and, for the overlap asked for, its smallest set.
        self.corner = np.stack([self.points[leaf].max(axis=0) for leaf in self.leaves])
        self.least = np.array([self.sizes[leaf].min() for leaf in self.leaves])
        self.inner = [list(range(i, min(i + _LEAF, len(self.leaves)))) for i in range(0, len(self.leaves), _LEAF)]
        self.inner_corner = np.stack([self.corner[node].max(axis=0) for node in self.inner])
        self.inner_least = np.array([self.least[node].min() for node in self.inner])

    def _passing(self, point: np.ndarray, size: int, corners: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.minimum(point, corners).sum(axis=1) >= required_overlap(size + sizes, self.percent))

    def candidates(self, point: np.ndarray, size: int) -> np.ndarray:
        """Points whose bound reaches the overlap that the threshold asks for."""
        nodes = self._passing(point, size, self.inner_corner, self.inner_least)
        boxes = [b for node in nodes.tolist() for b in self.inner[node]]
        if not boxes:
            return np.zeros(0, np.int64)
        passed = self._passing(point, size, self.corner[boxes], self.least[boxes])
        if not len(passed):
            return np.zeros(0, np.int64)
        at = np.concatenate([self.leaves[boxes[i]] for i in passed.tolist()])
        return at[self._passing(point, size, self.points[at], self.sizes[at])]


def links(nodes: list[int], sets: list[np.ndarray], sides: list[int], percent: int) -> list[tuple[int, int]]:
    """Enough of the links between the given sets to connect all that are connected.

    Sides: two sets of side 1, or two of side 2, are not compared; 0 is compared with all.
    """
    tree, forest, found = CountTree(sets, percent), Forest(), []
    side = np.array(sides)
    for i, own in enumerate(sets):
        near = tree.candidates(tree.points[i], len(own))
        near = near[(near < i) & ((side[near] != side[i]) | (side[i] == 0))]
        for j in near.tolist():
            if forest.root(i) == forest.root(j):
                continue
            common = len(np.intersect1d(own, sets[j], assume_unique=True))
            if common >= required_overlap(len(own) + len(sets[j]), percent):
                forest.join(i, j)
                found.append((nodes[i], nodes[j]))
    return found


def _search(width: int, percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each block; rows come sorted by block and node: block, node, side, text."""
    held: tuple[list, list, list] = ([], [], [])
    block = None

    def found() -> pa.RecordBatch:
        nodes, sides, texts = held
        values, offsets = shingle_sets(texts, width)
        sets = [values[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        pairs = links(nodes, sets, sides, percent) if len(nodes) > 1 else []
        return pa.RecordBatch.from_arrays(
            [pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())], ["a", "b"]
        )

    for batch in batches:
        blocks, nodes, sides = (batch.column(i).to_pylist() for i in range(3))
        for key, node, side, text in zip(blocks, nodes, sides, byte_texts(batch.column(3)), strict=True):
            if key != block and held[0]:
                yield found()
                held = ([], [], [])
            block = key
            # Another copy of the same text.
            if held[0] and held[0][-1] == node and held[1][-1] == side:
                continue
            held[0].append(node)
            held[1].append(side)
            held[2].append(text)
    if held[0]:
        yield found()


def _with_node(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, text and node of each text that is the task's first of its id and node."""
    fresh = _Once()
    for batch in slices(batches, "text", _SLICE_BYTES):
        values, offsets = shingle_sets(byte_texts(batch.column(1)), width)
        sets = [values[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        nodes = [_node(own) if len(own) else None for own in sets]
        first = [node is not None and fresh((i, node)) for i, node in zip(batch.column(0).to_pylist(), nodes, strict=True)]
        made = pa.RecordBatch.from_arrays([*batch.columns, pa.array(nodes, pa.int64())], ["id", "text", "node"])
        yield made.filter(pa.array(first, pa.bool_()))


def _links_of(rows: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Verified links of ``rows`` (block, node, side, id), which meet their texts here. Runs jobs.

    Few documents are in families. Up to a stated number of rows they are sent to the texts, so that
    only their texts are hashed and shuffled; beyond it both sides are dealt out by id and node. A null id is
    an id like others here.
    """
    rows = cut_lineage(rows.select("block", "node", "side", F.col("id").alias("of")))
    n = rows.count()
    if not n:
        return rows.select(F.col("node").alias("a"), F.col("node").alias("b"))
    few = n <= SENT_ROWS
    if few:
        texts = texts.join(F.broadcast(rows.select("of").distinct()), F.col("id").eqNullSafe(F.col("of")), "left_semi")
    id_type = texts.schema["id"].dataType.simpleString()
    named = texts.mapInArrow(partial(_with_node, width), f"id {id_type}, text string, node long").withColumnRenamed("node", "own")
    sent = F.broadcast(rows) if few else rows.hint("merge")
    fetched = named.join(sent, F.col("id").eqNullSafe(F.col("of")) & (F.col("own") == F.col("node")))
    dealt = fetched.select("block", "node", "side", "text").repartition("block").sortWithinPartitions("block", "node", "side")
    return cut_lineage(dealt.mapInArrow(partial(_search, width, percent), "a long, b long"))


def _popular(sets: DataFrame) -> np.ndarray:
    """N-grams in at least one of a hundred sets of a sample: at most some 100 for each n-gram of a set, and ``POPULAR``.

    They only settle the order of n-grams, so the sample decides how fast the search is, not what it finds. Runs a job.
    """
    each = sets.filter("grams is not null").select("node", F.explode("grams").alias("gram")).distinct()
    counts = each.groupBy("gram").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= SAMPLE_ROWS // 100)
    found = counts.orderBy(F.desc("c"), "gram").limit(POPULAR).select("gram").toArrow().column("gram").to_numpy()
    return np.sort(found.astype(np.int64).view(np.uint64))


def _families(texts: DataFrame, popular: np.ndarray, width: int, percent: int) -> DataFrame:
    """Vertices (node) and family (root) of all nodes that share an n-gram of their prefixes with another. Runs jobs."""
    each = texts.select("text").mapInArrow(partial(_prefixes, width, percent, popular), "key long, value long, kind byte")
    # Copies of a set fall together where their n-grams meet; what is counted are sets. Nothing is written before.
    each = each.repartition("key").groupBy("key", "value", "kind").agg(F.lit(1).alias("one")).drop("one")
    counted = each.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("key", "kind")))
    shared = cut_lineage(counted.filter((F.col("kind") != _RARE) | (F.col("k") > 1)))
    by_node = Window.partitionBy("node")
    rare = shared.filter(F.col("kind") == _RARE).select(F.col("key").alias("gram"), F.col("value").alias("node"), "k")
    ranked = rare.withColumns(
        {"rank": F.row_number().over(by_node.orderBy("k", "gram")), "n_shared": F.count(F.lit(1)).over(by_node)}
    )
    # Unshared n-grams come first in the order: what they leave of the prefix is filled with shared ones.
    rooms = shared.filter(F.col("kind") == _ROOM).select(F.col("key").alias("node"), F.col("value").alias("room"))
    kept = ranked.join(rooms, "node").filter(F.col("rank") <= F.col("room") + F.col("n_shared"))
    kept = cut_lineage(kept.select("gram", "node"))
    hubs = cut_lineage(kept.groupBy("gram").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("c")).filter("c > 1"))
    edges = kept.join(hubs, "gram").filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    chained = shared.filter(F.col("kind") == _EDGE).select(F.col("key").alias("a"), F.col("value").alias("b"))
    return connected_components(edges.unionByName(chained).distinct())


def _block(*parts: Column | str) -> Column:
    return F.xxhash64(*parts)


def _first_blocks(members: DataFrame) -> DataFrame:
    """Every family in blocks; the family's anchor, its smallest node, stands in each of them."""
    count = F.ceil((F.col("size") - 1) / (BLOCK - 1))
    plain = members.filter("node <> family").select(
        "node", "id", _block("family", F.pmod(F.xxhash64("node"), count)).alias("block"), F.lit(0).alias("side")
    )
    anchors = members.filter("node = family").select(
        "node", "id", "family", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("i")
    )
    return plain.unionByName(anchors.select("node", "id", _block("family", "i").alias("block"), F.lit(0).alias("side")))


def _later_blocks(members: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """Pairs of blocks of those families that are still in several parts.

    Blocks hold sets of one size band, so that only the same and the next band can match. Those outside
    the family's largest part meet each other and those of the largest part. Runs jobs.
    """
    placed = members.join(parts.withColumnRenamed("root", "part"), "node", "left")
    placed = cut_lineage(placed.withColumn("part", F.coalesce("part", "node")))
    by_part = placed.groupBy("family", "part").agg(F.count(F.lit(1)).alias("c"))
    largest = by_part.groupBy("family").agg(F.max(F.struct("c", "part")).alias("top"), F.count(F.lit(1)).alias("parts"))
    largest = cut_lineage(largest.filter("parts > 1").select("family", F.col("top.part").alias("main")))
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent * 1.001)).cast("int")
    open_ = placed.join(largest, "family").select(
        "node", "id", "family", band.alias("band"), (F.col("part") == F.col("main")).alias("inside")
    )
    open_ = cut_lineage(open_)
    blocks = F.ceil(F.count(F.when(F.col("inside"), 1)) / BLOCK), F.ceil(F.count(F.when(~F.col("inside"), 1)) / BLOCK)
    counts = open_.groupBy("family", "band").agg(blocks[0].alias("n_in"), blocks[1].alias("n_out"))
    counts = cut_lineage(counts)
    # Every node with each band that it meets: its own and the two beside it.
    near = open_.withColumn("other", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    own = counts.select("family", "band", F.col("n_in").alias("own_in"), F.col("n_out").alias("own_out"))
    beside = counts.select("family", F.col("band").alias("other"), "n_in", "n_out")
    met = near.join(own, ["family", "band"]).join(beside, ["family", "other"])
    place = F.pmod(F.xxhash64("node"), F.when(F.col("inside"), F.col("own_in")).otherwise(F.col("own_out")))
    met = met.withColumn("place", place)
    low, high = F.least("band", "other"), F.greatest("band", "other")
    # Outside with outside, the lower band first; equal bands in both orders fall together.
    up = F.col("band") < F.col("other")
    same = F.col("band") == F.col("other")
    outer = met.filter(~F.col("inside") & (F.col("n_out") > 0)).withColumn(
        "j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_out") - 1))
    )
    first = F.when(same, F.least("place", "j")).when(up, F.col("place")).otherwise(F.col("j"))
    second = F.when(same, F.greatest("place", "j")).when(up, F.col("j")).otherwise(F.col("place"))
    side = F.when(same & (F.col("place") == F.col("j")), 0).when(same, F.when(F.col("place") < F.col("j"), 1).otherwise(2))
    side = side.otherwise(F.when(up, 1).otherwise(2))
    outer = outer.select("node", "id", _block(F.lit("oo"), "family", low, high, first, second).alias("block"), side.alias("side"))
    # Outside with inside: the outside block's band and place name the pair first.
    n_other = F.when(F.col("inside"), F.col("n_out")).otherwise(F.col("n_in"))
    cross = met.filter(n_other > 0).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), n_other - 1)))
    inside = F.col("inside")
    name = [
        F.when(inside, F.col("other")).otherwise(F.col("band")),
        F.when(inside, F.col("band")).otherwise(F.col("other")),
        F.when(inside, F.col("j")).otherwise(F.col("place")),
        F.when(inside, F.col("place")).otherwise(F.col("j")),
    ]
    cross = cross.select(
        "node", "id", _block(F.lit("oi"), "family", *name).alias("block"), F.when(inside, 1).otherwise(2).alias("side")
    )
    return outer.unionByName(cross)


def _resolved(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """id, n, node, root (a node of the component) and component of every row. Runs jobs."""
    if not 0 < percent <= 100 or width < 1:
        raise ValueError("percent must be within 1 to 100, and width at least 1")
    id_type = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    share = min(1.0, SAMPLE_ROWS / max(texts.count(), 1))
    schema = f"id {id_type}, n long, node long, grams array<long>"
    sets = cut_lineage(texts.mapInArrow(partial(_sets, width, percent, share), schema))
    popular = _popular(sets)
    nodes = cut_lineage(sets.filter("node is not null").groupBy("node").agg(F.min("id").alias("id"), F.max("n").alias("n")))
    # Without the n-grams among the vertices; a family goes by its smallest node.
    found = cut_lineage(_families(texts, popular, width, percent).join(nodes, "node"))
    anchors = found.groupBy("root").agg(F.min("node").alias("family"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = cut_lineage(found.join(cut_lineage(anchors), "root").drop("root"))
    first = _links_of(_first_blocks(members), texts, width, percent)
    parts = connected_components(first)
    large = members.filter(F.col("size") > BLOCK)
    second = _links_of(_later_blocks(large, parts, percent), texts, width, percent)
    linked = connected_components(first.unionByName(second)) if not second.isEmpty() else parts
    named = linked.join(nodes.select("node", "id"), "node")
    least = cut_lineage(named.groupBy("root").agg(F.min("id").alias("component")))
    of_node = nodes.select("node", F.col("id").alias("own")).join(linked.join(least, "root"), "node", "left")
    of_node = of_node.select("node", F.coalesce("root", "node").alias("root"), F.coalesce("component", "own").alias("component"))
    return sets.select("id", "n", "node").join(cut_lineage(of_node), "node", "left")


def components(
    docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The id, ``n_shingles`` and ``component_id`` of every row: the smallest id that links reach. Runs jobs.

    Two texts are linked if 100 * intersection >= percent * union of their sets of ``width`` words.
    """
    return _resolved(docs, width, percent, id_col, text_col).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id")
    )


def _with_nodes(width: int, place: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with the node of the text at ``place`` as a last column."""
    for batch in slices(batches, f"c{place}", _SLICE_BYTES):
        values, offsets = shingle_sets(byte_texts(batch.column(place).cast(pa.string())), width)
        sets = [values[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        nodes = [_node(own) if len(own) else None for own in sets]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nodes, pa.int64())], [*batch.schema.names, "node"])


def keep_one_of_each(
    docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The given table with one row of each component: of the smallest id, and there of the smallest node.

    Rows are removed by id and text, so another text of the same id stays. Rows with a null id, and
    texts without words, stay. Runs jobs.
    """
    found = cut_lineage(_resolved(docs, width, percent, id_col, text_col).filter("id is not null").select("id", "node", "root"))
    least = found.filter("node is not null").groupBy("root").agg(F.min(F.struct("id", "node")).alias("kept"))
    gone = found.join(least, "root").filter(F.struct("id", "node") != F.col("kept")).select("id", "node").distinct()
    gone = cut_lineage(gone)
    # Only of ids with several rows must the texts be told apart.
    several = cut_lineage(found.groupBy("id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("id"))
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    own, place = f"c{docs.columns.index(id_col)}", docs.columns.index(text_col)
    away = gone.select("id").unionByName(several).distinct()
    single = plain.join(away, plain[own] == away["id"], "left_anti")
    repeated = plain.join(several, plain[own] == several["id"], "left_semi")
    fields = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields), "node long"])
    repeated = repeated.mapInArrow(partial(_with_nodes, width, place), fields)
    left = repeated.join(gone, (repeated[own] == gone["id"]) & (repeated["node"] == gone["node"]), "left_anti")
    first = F.min_by(F.struct(*plain.columns), F.xxhash64(F.col(f"c{place}").cast("string"))).alias("row")
    one = left.filter("node is not null").groupBy(own, "node").agg(first).select("row.*")
    wordless = left.filter("node is null").drop("node")
    return single.unionByName(one).unionByName(wordless).toDF(*docs.columns)
