"""Product quantisation of vectors with exact integer codebooks and equal-average search.

Each component x becomes the integer floor(4096 * x); a vector is cut into ``PARTS`` equal consecutive parts, and
each part position has a codebook. A codebook starts as that part of the ``ENTRIES`` rows with the smallest ids;
in each round every part goes to its nearest entry (squared Euclidean distance, ties to the lower index), and an entry
becomes the componentwise floor of its parts' mean; one without parts stays.

The nearest entry is found by equal-average search. By Cauchy and Schwarz the squared difference of two parts'
component sums is at most their dimension times their squared distance. Entries are sorted by sum; from the place of
a part's own sum the search goes outward, always to the nearer side, until the squared gap of sums is strictly
larger than the dimension times the best distance: no entry beyond can be nearer or tie.

All of it is whole numbers. Arithmetic is in 64 bits where the magnitudes at hand allow that no square or sum
overflows, and in Python's unbounded integers where not. A round is one pass over the table: tasks hold sums
and counts for each entry, Spark adds them up, and the codebooks, whose size depends on the dimension only, come to
the driver. Sums travel as decimal limbs, so they cannot overflow either.

Defined results: rows whose vector is null or has null or non-finite components are dropped. The dimension is that of the
kept vector with the smallest id whose length is a positive multiple of ``PARTS``; rows of another length get a null code and
error and shape no entry. Rows without an id come last in the order of ids, rows of equal ids are ordered by their
vectors; with fewer rows than ``ENTRIES`` the codebooks have fewer entries. An error that 64 bits cannot hold is null.
An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
# Sums are split to this base, so that a decimal of 38 digits can add up a hundred billion of them.
_LIMB = 10**27
_LONG = 1 << 63
# Vectors looked at together.
_ROWS = 4096

Codebooks = list[list[list[int]]]


def quantised(value: float) -> int:
    """floor(4096 * value), exactly: beyond 2^53 a double is whole, and the product could overflow."""
    return int(value) * SCALE if abs(value) >= 1 << 53 else math.floor(SCALE * value)


def _integers(rows: np.ndarray) -> np.ndarray:
    """A table of doubles as integers: 64-bit ones where all are small, Python's where not."""
    if not rows.size or np.abs(rows).max() < 1 << 40:
        return np.floor(rows * SCALE).astype(np.int64)
    whole = np.empty(rows.shape, object)
    whole[...] = [[quantised(x) for x in row] for row in rows.tolist()]
    return whole


class EqualAverageSearch:
    """Entries of one codebook, sorted by the sum of their components."""

    def __init__(self, entries: list[list[int]]):
        exact = np.array(entries, object).reshape(len(entries), -1)
        self.dimension = exact.shape[1]
        self.top = max((abs(x) for row in entries for x in row), default=0)
        sums = exact.sum(axis=1)
        self.order = np.array(sorted(range(len(entries)), key=lambda i: (sums[i], i)), np.int64)
        self.entries, self.sums = exact[self.order], sums[self.order]

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of and squared distance to the nearest entry of each part; the lower index on ties."""
        n, k, d = len(parts), len(self.order), self.dimension
        top = max(int(np.abs(parts).max()) if parts.size else 0, self.top)
        # The largest number met is the square of a gap of sums, (2 * d * top)^2.
        small = d * top < 1 << 30 and parts.dtype != object
        kind = np.int64 if small else object
        parts = parts.astype(kind)
        entries, sums = self.entries.astype(kind), self.sums.astype(kind)
        own = parts.sum(axis=1)
        right = np.searchsorted(sums, own).astype(np.int64)
        left = right - 1
        index, best = np.zeros(n, np.int64), np.zeros(n, kind)
        begun, open_ = np.zeros(n, bool), np.ones(n, bool)
        for _ in range(k):
            rows = np.flatnonzero(open_)
            if not len(rows):
                break
            lower, upper = left[rows], right[rows]
            below = np.where(lower >= 0, own[rows] - sums[np.maximum(lower, 0)], 0)
            above = np.where(upper < k, sums[np.minimum(upper, k - 1)] - own[rows], 0)
            down = (lower >= 0) & ((upper >= k) | (below <= above).astype(bool))
            gap = np.where(down, below, above)
            go = ~begun[rows] | ~(gap * gap > d * best[rows]).astype(bool)
            open_[rows[~go]] = False
            rows, down = rows[go], down[go]
            place = np.where(down, left[rows], right[rows])
            left[rows[down]] -= 1
            right[rows[~down]] += 1
            apart = parts[rows] - entries[place]
            distance = (apart * apart).sum(axis=1)
            entry = self.order[place]
            better = ~begun[rows] | (distance < best[rows]).astype(bool)
            better |= (distance == best[rows]).astype(bool) & (entry < index[rows])
            index[rows[better]], best[rows[better]] = entry[better], distance[better]
            begun[rows] = True
            open_[rows] = (left[rows] >= 0) | (right[rows] < k)
        return index, best


def _kept(table: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    named = [F.col("`" + c.replace("`", "``") + "`") for c in (id_col, vector_col, label_col)]
    rows = table.select(named[0].alias("id"), named[1].cast("array<double>").alias("vector"), named[2].alias("label"))
    finite = F.forall("vector", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return rows.filter(F.col("vector").isNotNull() & finite)


def _tables(batches: Iterator[pa.RecordBatch], dimension: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Pieces of batches, which of their rows have the dimension, and those rows' integers."""
    for whole in batches:
        for start in range(0, whole.num_rows, _ROWS):
            batch = whole.slice(start, _ROWS)
            column = batch.column(batch.schema.get_field_index("vector"))
            fits = np.asarray(column.value_lengths()) == dimension
            values = column.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False)
            yield batch, fits, _integers(values.reshape(int(fits.sum()), max(dimension, 0)))


def _sums(books: Codebooks, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's parts: sum of each component and number (place -1) for each entry, in limbs."""
    searches = [EqualAverageSearch(book) for book in books]
    width = searches[0].dimension
    sums = np.zeros((len(books), len(books[0]), width + 1), object)
    for _, _, rows in _tables(batches, width * len(books)):
        for part, search in enumerate(searches):
            own = rows[:, part * width : (part + 1) * width]
            index, _ = search.nearest(own)
            for entry in np.unique(index).tolist():
                members = own[index == entry]
                sums[part, entry, :width] += members.sum(axis=0).astype(object)
                sums[part, entry, width] += len(members)
    found = []
    for (part, entry, place), value in np.ndenumerate(sums):
        sign, rest, limb = (-1 if value < 0 else 1), abs(int(value)), 0
        while rest:
            rest, low = divmod(rest, _LIMB)
            found.append((part, entry, place if place < width else -1, limb, sign * low))
            limb += 1
    if found:
        columns = list(zip(*found, strict=True))
        types = [pa.int32()] * 4 + [pa.decimal128(38, 0)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["part", "entry", "place", "limb", "value"]
        )


def _updated(books: Codebooks, rows: DataFrame) -> Codebooks:
    """One round: the floor of the mean of each entry's parts. Runs a job."""
    each = rows.select("vector").mapInArrow(partial(_sums, books), "part int, entry int, place int, limb int, value decimal(38,0)")
    totals: dict[tuple[int, int, int], int] = {}
    for row in each.groupBy("part", "entry", "place", "limb").agg(F.sum("value").alias("value")).collect():
        key = row["part"], row["entry"], row["place"]
        totals[key] = totals.get(key, 0) + int(row["value"]) * _LIMB ** row["limb"]
    new = [[list(entry) for entry in book] for book in books]
    for part, book in enumerate(new):
        for i, entry in enumerate(book):
            if count := totals.get((part, i, -1)):
                book[i] = [totals.get((part, i, place), 0) // count for place in range(len(entry))]
    return new


def fit_codebooks(
    table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> Codebooks:
    """Codebooks by part, entry and component; empty where no vector can be cut. Runs a job a round."""
    rows = _kept(table, id_col, vector_col, id_col)
    first = rows.filter((F.size("vector") > 0) & (F.size("vector") % parts == 0))
    in_order = [F.asc_nulls_last("id"), F.col("vector")]
    least = first.orderBy(*in_order).select("vector").first()
    if least is None:
        return []
    dimension = len(least["vector"])
    start = first.filter(F.size("vector") == dimension).orderBy(*in_order).limit(entries).select("vector").collect()
    whole = [[quantised(x) for x in row["vector"]] for row in start]
    width = dimension // parts
    books = [[row[part * width : (part + 1) * width] for row in whole] for part in range(parts)]
    for _ in range(rounds):
        books = _updated(books, rows)
    return books


def codebooks_digest(books: Codebooks) -> str:
    """SHA-256 of all components as decimal integers by part, entry and place, comma-joined."""
    return hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()


def encode(
    table: DataFrame, books: Codebooks, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """The id, label, ``code`` (two hex digits a part) and ``error`` of every kept vector. No shuffle."""
    rows = _kept(table, id_col, vector_col, label_col)
    names = [f.name for f in rows.schema.fields if f.name != "vector"]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = [EqualAverageSearch(book) for book in books]
        width = searches[0].dimension if searches else 1
        for batch, fits, whole in _tables(batches, width * len(books) if books else -1):
            codes, errors = [""] * len(whole), [0] * len(whole)
            for part, search in enumerate(searches):
                index, distance = search.nearest(whole[:, part * width : (part + 1) * width])
                codes = [f"{code}{i:02x}" for code, i in zip(codes, index.tolist(), strict=True)]
                errors = [e + int(x) for e, x in zip(errors, distance.tolist(), strict=True)]
            all_codes, all_errors = np.full(batch.num_rows, None, object), np.full(batch.num_rows, None, object)
            all_codes[fits] = codes
            all_errors[fits] = [e if e < _LONG else None for e in errors]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(batch.schema.get_field_index(n)) for n in names], pa.array(all_codes, pa.string()), pa.array(all_errors, pa.int64())],
                [*names, "code", "error"],
            )

    return rows.mapInArrow(run, f"{fields}, code string, error long")


def decode(code: str, books: Codebooks) -> list[float]:
    """The vector that a code stands for."""
    entries = [book[int(code[2 * i : 2 * i + 2], 16)] for i, book in enumerate(books)]
    return [x / SCALE for entry in entries for x in entry]


def compress(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """The id, ``code``, ``error``, ``label_error`` (summed over equal labels) and ``codebooks_sha256``. Runs jobs."""
    books = fit_codebooks(table, id_col, vector_col)
    coded = cut_lineage(encode(table, books, id_col, vector_col, label_col))
    # Summed before the shuffle and written first: a small table of labels is broadcast, and otherwise
    # adaptive execution can split a label that many rows have.
    total = F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long")
    by_label = cut_lineage(coded.groupBy(F.col("label").alias("of")).agg(total.alias("label_error")))
    joined = coded.join(by_label, F.col("label").eqNullSafe(F.col("of")), "left")
    return joined.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))


def _oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same in SQL: every round compares each part with every entry of its codebook."""
    steps = [
        f"""v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (
  SELECT r, part, e[part * w + 1:part * w + w] AS x FROM (SELECT r, e, len(e) // {parts} AS w, unnest(range({parts})) AS part FROM v)),
b0 AS MATERIALIZED (SELECT part, r - 1 AS entry, x FROM p WHERE r <= {entries})"""
    ]
    near = """a{0} AS MATERIALIZED (
  SELECT r, part, min(struct_pack(d := d, entry := entry)) AS m FROM (
    SELECT r, p.part, entry, list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - b.x[i]) * (p.x[i] - b.x[i])))::BIGINT AS d
    FROM p JOIN b{0} b ON b.part = p.part) GROUP BY r, part)"""
    mean = """b{1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(n.x, b.x) AS x FROM b{0} b LEFT JOIN (
    SELECT part, entry, list(((s - ((s % c) + c) % c) // c)::BIGINT ORDER BY i) AS x FROM (
      SELECT part, entry, i, sum(y) AS s, count(*) AS c FROM (
        SELECT p.part, m.entry AS entry, unnest(x) AS y, unnest(range(len(x))) AS i FROM p JOIN a{0} USING (r, part)) GROUP BY part, entry, i)
    GROUP BY part, entry) n ON n.part = b.part AND n.entry = b.entry)"""
    for i in range(rounds):
        steps += [near.format(i), mean.format(i, i + 1)]
    steps.append(near.format(rounds))
    return f"""
WITH {", ".join(steps)},
coded AS (
  SELECT r, string_agg(lower(printf('%02x', m.entry)), '' ORDER BY part) AS code, sum(m.d)::BIGINT AS error FROM a{rounds} GROUP BY r),
digest AS (
  SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM v JOIN coded USING (r), digest"""


ORACLE = _oracle()
