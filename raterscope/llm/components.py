"""Connected components of a graph given as a table of edges, without gathering it anywhere.

Alternating star contraction: each round links every node's larger neighbours, then its smaller ones, to
the smallest node around it, until the edges are stars. Before the rounds, every task replaces its
own edges by a spanning forest, so that dense groups shrink where they lie. If few edges are left, a stated
number, one task joins them at once. Rounds are written to the shared folder; the joins read written
tables, so adaptive execution can split a node with very many neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


# Edges that one task joins at most: some 100 MB.
TASK_EDGES = 400_000


class Forest:
    """Union-find over any nodes; the smallest node of a tree is its root."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, node: int) -> int:
        parent = self.parent
        parent.setdefault(node, node)
        top = node
        while parent[top] != top:
            top = parent[top]
        while parent[node] != top:
            parent[node], node = top, parent[node]
        return top

    def join(self, a: int, b: int) -> bool:
        """Whether the two were apart until now."""
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        forest = Forest()
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.join(a, b)
        edges = [(n, forest.root(n)) for n in list(forest.parent)]
        edges = [(n, r) for n, r in edges if n != r]
        yield pa.RecordBatch.from_arrays(
            [pa.array([n for n, _ in edges], pa.int64()), pa.array([r for _, r in edges], pa.int64())], ["a", "b"]
        )


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.join(a, b)
    nodes = list(forest.parent)
    yield pa.RecordBatch.from_arrays(
        [pa.array(nodes, pa.int64()), pa.array([forest.root(n) for n in nodes], pa.int64())], ["node", "root"]
    )


def _stars(edges: DataFrame, neighbours: DataFrame) -> DataFrame:
    """Edges from each node's ``neighbours`` and itself to the smallest node among them."""
    least = cut_lineage(neighbours.groupBy("a").agg(F.min("b").alias("m")))
    moved = neighbours.join(least.withColumn("m", F.least("a", "m")), "a")
    return moved


def connected_components(edges: DataFrame) -> DataFrame:
    """For each node that an edge names (``a``, ``b``, long): ``node`` and ``root``, the smallest node it reaches.

    Runs jobs, a few for each round; the rounds grow as the logarithm of the longest path.
    """
    current = edges.select("a", "b").filter("a <> b").mapInArrow(_forests, "a long, b long").distinct()
    current, before = cut_lineage(current), None
    if current.count() <= TASK_EDGES:
        return cut_lineage(current.coalesce(1).mapInArrow(_joined, "node long, root long"))
    while True:
        # Large star: the larger neighbours of a node go to the smallest one.
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _stars(current, both).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut_lineage(large.distinct())
        # Small star: a node and its smaller neighbours go to the smallest one.
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        moved = _stars(large, down)
        small = moved.select("a", F.col("m").alias("b")).unionByName(moved.select(F.col("b").alias("a"), F.col("m").alias("b")))
        current = cut_lineage(small.filter("a <> b").distinct())
        state = current.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long"))).first()
        if state == before:
            break
        before = state
    leaves = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return cut_lineage(leaves.unionByName(leaves.select(F.col("root").alias("node"), "root").distinct()))
