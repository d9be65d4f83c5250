"""Best-fit packing of tokenized documents into sequences of a fixed number of tokens.

Bulk-synchronous rounds. Pieces and gaps are sorted by size and cut into ranges of sizes, one task each. A
task sweeps its pieces from the longest down and matches each with its successor, the smallest gap of its range
that holds it; a gap that was filled goes on with what is left of it. Pieces of several ranges that find no gap in their
own want the same larger gaps: the next round joins neighbouring ranges, and the longest of them is served first.
In the last round, of one range, what is still without a gap opens sequences. Classes of lengths follow each other, each
half as long as the one before, so that the gaps which long pieces leave are there when shorter ones come.

Both sort orders are held as runs. Lengths and gaps are whole numbers up to the capacity, and pieces of
one length are interchangeable, as are sequences with the same gap, so a run of equal pieces is matched
with a run of equal gaps at once. The tables that the rounds read and write therefore depend on the capacity, never on
the number of documents: they start with one row for each length. What does grow is ranking the pieces within their
length, and that is distributed: each length is cut into about the square root of its count of hash buckets, which are
ranked on their own and shifted by the buckets before them. A piece's sequence and offset follow from its rank.

Defined results: a null text is an empty one and has one piece, its end token; repeated rows and null
ids are documents of their own; an empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import bisect
import os
import re
import struct
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, intermediate_tables
from .text import slices

CAPACITY = 2048
END_ID = 0
_SLICE_BYTES = 1 << 20
# Characters that stay as they are composed and whose lower case is one character; U+0130 has two.
_PLAIN = [chr(c) for c in range(0x250) if c != 0x130]
_OTHER = re.compile("[^\\x00-\u012f\u0131-\u024f]")
_WHITE = "\t\n\v\f\r \x85\xa0"


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself where it is printable, else the next free one."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _splitter() -> re.Pattern:
    """Words, single digits, English endings and runs of marks of a lower-case text of plain characters."""
    lower = {c.lower() for c in _PLAIN}
    letters, digits = ("".join(sorted(c for c in lower if unicodedata.category(c)[0] == kind)) for kind in "LN")
    return re.compile(f"[{letters}]+|[{digits}]|'(?:s|t|re|ve|m|ll|d)|[^{_WHITE}{letters}{digits}]+")


class _Remembered(dict):
    """What ``make`` gives for each key, remembered in two generations.

    When the younger one is full it becomes the older one, from which what is met again comes back. Long keys, which
    hardly return, are made anew.
    """

    ENTRIES = 120_000
    LONGEST = 64

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make = make
        self.older: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.LONGEST:
            self[key] = value
        return value

    def age(self) -> None:
        if len(self) > self.ENTRIES:
            self.older = dict(self)
            self.clear()


class CachedTokenizer:
    """Token ids of texts from the library, asked once for each distinct part of a text that is met often.

    Only for tokenizers that drop white space and split at it; their tokens never reach across it. Texts of plain
    characters are lowered and split here, and their words and marks go to the library's model directly. That this equals
    the library's own normalising and splitting is tested on every plain character before words, digits, marks and endings;
    a tokenizer that fails the test is never served so. All other texts, and those with special strings, are
    taken stretch by stretch: between white space, and by the library as a whole unless a stretch is plain.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        probe = [self._whole(t) for t in ("a b", " a \n b ", "a\n\nb", "a , b", "a, b")]
        special = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        if probe[1:3] != probe[:1] * 2 or probe[3] != probe[4] or any(re.search(r"\s", s) for s in special):
            raise ValueError("this tokenizer keeps white space; stretches between it cannot be asked for alone")
        self.special = re.compile("|".join(map(re.escape, special)) or "(?!)")
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.parts = _splitter().findall
        self.words = _Remembered(self._word)
        self.stretches = _Remembered(self._stretch)
        self.bare = True
        self.bare = all(self._plain(t) == self._whole(t) for t in self._probes())

    @staticmethod
    def _probes() -> list[str]:
        around = [f"a{c}b {c}1{c}{c} .{c}s '{c}'S{c}'re {c}, x{c}" for c in _PLAIN]
        return [" ".join(around), "".join(_PLAIN), "".join(reversed(_PLAIN)), "We'LL he'D it's ''s 'tis 12,345.67 x" + "y" * 99]

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of one part, spelled in the letters that stand for its bytes."""
        spelled = word if word.isascii() and word.isalpha() else word.encode().decode("latin-1").translate(self.letters)
        ids = [token.id for token in self.model.tokenize(spelled)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.parts(text.lower())))

    def _is_plain(self, text: str) -> bool:
        return self.bare and not _OTHER.search(text) and not self.special.search(text)

    def _stretch(self, stretch: str) -> bytes:
        return self._plain(stretch) if self._is_plain(stretch) else self._whole(stretch)

    def _encoded(self, text: str) -> bytes:
        if self._is_plain(text):
            return self._plain(text)
        return b"".join(map(self.stretches.__getitem__, text.replace("\n", " ").split(" ")))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        found = [self._encoded(text) for text in texts]
        self.words.age()
        self.stretches.age()
        return found


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> CachedTokenizer:
    return CachedTokenizer(path)


def token_pieces(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of every document's ids, the end id included: the id, piece, start, length, ids_crc32.

    Only documents of more than ``capacity`` ids have several. ``with_ids`` adds the ids themselves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _tokenizer(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        step = 4 * capacity
        for batch in slices(batches, "text", _SLICE_BYTES):
            rows, pieces, starts, lengths, sums, held = [], [], [], [], [], []
            for row, ids in enumerate(machine.encode([t or "" for t in batch.column(1).to_pylist()])):
                ids += end
                for piece, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    rows.append(row)
                    pieces.append(piece)
                    starts.append(at // 4)
                    lengths.append(len(part) // 4)
                    sums.append(zlib.crc32(part))
                    if with_ids:
                        held.append(np.frombuffer(part, "<u4").astype(np.int64))
            columns = [
                batch.column(0).take(pa.array(rows, pa.int64())),
                pa.array(pieces, pa.int32()),
                *(pa.array(x, pa.int64()) for x in (starts, lengths, sums)),
            ]
            names = [id_col, "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(held, pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    id_type = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    schema = f"`{id_col}` {id_type}, piece int, start long, length long, ids_crc32 long"
    return narrow.mapInArrow(run, schema + (", ids array<long>" if with_ids else ""))


@dataclass(frozen=True)
class Match:
    """Pieces of one length, from ``rank`` on, ``each`` of them into every one of ``bins`` equal gaps."""

    length: int
    rank: int
    each: int
    bins: int
    sequence: int
    offset: int


class Gaps:
    """Open sequences in order of their gap, as runs of consecutive numbers."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.sizes: list[int] = []
        self.runs: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.opened = 0

    def add(self, gap: int, first: int, count: int) -> None:
        if gap and count:
            if not self.runs[gap]:
                bisect.insort(self.sizes, gap)
            self.runs[gap].append((first, count))

    def successor(self, length: int, pieces: int, opening: bool) -> tuple[int, int, int] | None:
        """Of the smallest gap that holds ``length``, as many sequences as so many pieces fill: gap, first, count.

        Where no gap holds it, new sequences if ``opening``, else None.
        """
        at = bisect.bisect_left(self.sizes, length)
        if at == len(self.sizes) and not opening:
            return None
        gap = self.sizes[at] if at < len(self.sizes) else self.capacity
        each = gap // length
        wanted = max(1, pieces // each)
        if at == len(self.sizes):
            first = self.opened
            self.opened += wanted
            return gap, first, wanted
        first, count = self.runs[gap].pop()
        used = min(count, wanted)
        if used < count:
            self.runs[gap].append((first + used, count - used))
        if not self.runs[gap]:
            self.sizes.pop(at)
        return gap, first, used


def sweep(runs: Iterable[tuple[int, int, int]], gaps: Gaps, opening: bool) -> tuple[list[Match], list[tuple[int, int, int]]]:
    """Match runs of pieces (length, first rank, count) with their successors, the longest first; returns the matches and the runs left."""
    matches, without = [], []
    for length, rank, left in sorted(runs, reverse=True):
        if not 0 < length <= gaps.capacity:
            raise ValueError(f"a piece of {length} tokens does not fit into {gaps.capacity}")
        while left:
            successor = gaps.successor(length, left, opening)
            if successor is None:
                without.append((length, rank, left))
                break
            gap, first, bins = successor
            each = min(gap // length, left)
            matches.append(Match(length, rank, each, bins, first, gaps.capacity - gap))
            gaps.add(gap - each * length, first, bins)
            rank, left = rank + each * bins, left - each * bins
    return matches, without


# Kinds of rows in the table of a round: runs of pieces and of gaps, what was matched, and the number of open sequences.
_PIECES, _GAPS, _MATCHED, _OPENED = range(4)
_STATE = "kind int, size long, first long, n long, each long, sequence long, offset long"
# Ranges of the rounds of one class of lengths, and how many such classes there are; the last has all shorter pieces.
RANGES = (8, 2, 1)
CLASSES = 6


def _round(capacity: int, opening: bool):
    """The work of one range: the rows of its pieces and gaps after a sweep. Rows out of the round (part -1) stay as they are."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.drop_columns(["part"])
        if key[0].as_py() < 0:
            return table
        gaps, runs = Gaps(capacity), []
        for row in sorted(table.to_pylist(), key=lambda r: (r["kind"], r["size"], r["first"])):
            if row["kind"] == _PIECES:
                runs.append((row["size"], row["first"], row["n"]))
            elif row["kind"] == _GAPS:
                gaps.add(row["size"], row["first"], row["n"])
            else:
                gaps.opened = row["n"]
        matches, without = sweep(runs, gaps, opening)
        rows = [(_PIECES, *own, 0, 0, 0) for own in without]
        rows += [(_GAPS, gap, first, n, 0, 0, 0) for gap in gaps.sizes for first, n in gaps.runs[gap]]
        rows += [(_MATCHED, m.length, m.rank, m.bins, m.each, m.sequence, m.offset) for m in matches]
        if opening:
            rows.append((_OPENED, 0, 0, gaps.opened, 0, 0, 0))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), table.schema, strict=True)], schema=table.schema)

    return run


def best_fit(counts: DataFrame, capacity: int = CAPACITY) -> list[Match]:
    """Matches of all pieces: ``counts`` has their number ``n`` for each ``length``. Runs a job for each round.

    Every match ends a run of pieces or one of gaps, and a run of pieces makes two runs of gaps at most, so what the rounds
    hold and what is returned depends on the number of lengths alone.
    """
    spark = counts.sparkSession
    size = F.col("length").cast("long")
    zero = F.lit(0).cast("long")
    state = counts.select(F.lit(_PIECES).alias("kind"), size.alias("size"), zero.alias("first"), F.col("n").cast("long").alias("n"),
                          zero.alias("each"), zero.alias("sequence"), zero.alias("offset"))
    longest = F.least(F.floor(F.log2(F.lit(capacity) / F.greatest(size, F.lit(1)))), F.lit(CLASSES - 1))
    classes = counts.groupBy(longest.alias("class")).agg(F.min("length").alias("least"), F.max("length").alias("most")).orderBy("class").collect()
    with intermediate_tables(spark):
        state = cut_lineage(state.unionByName(spark.createDataFrame([(_OPENED, 0, 0, 0, 0, 0, 0)], _STATE)).coalesce(1))
        for own in classes:
            least, most = own["least"], own["most"]
            # The first class is longer than any gap.
            for ranges in RANGES if own is not classes[0] else RANGES[-1:]:
                pieces = (F.col("kind") == _PIECES) & F.col("size").between(least, most)
                taking = pieces | ((F.col("kind") == _GAPS) & (F.col("size") >= least))
                if ranges == RANGES[-1]:
                    taking |= F.col("kind") == _OPENED
                width = (most - least) // ranges + 1
                # Gaps beyond the longest piece belong to the last range.
                nth = F.greatest(F.least(F.floor((F.col("size") - least) / width), F.lit(ranges - 1)), F.lit(0))
                parted = state.withColumn("part", F.when(taking, nth).otherwise(-1).cast("int")).repartition(ranges, "part")
                state = cut_lineage(parted.groupBy("part").applyInArrow(_round(capacity, ranges == RANGES[-1]), _STATE))
        matched = state.filter(F.col("kind") == _MATCHED).collect()
    return [Match(r["size"], r["first"], r["each"], r["n"], r["sequence"], r["offset"]) for r in matched]


def rank_in_length(pieces: DataFrame, counts: DataFrame) -> DataFrame:
    """Add ``rank``: a number from 0 within each length, without gaps. Runs a job.

    ``pieces`` must be a written table, and ``counts`` has their number ``n`` for each ``length``. Rows that are equal in
    all columns may swap ranks, which changes nothing.
    """
    columns = pieces.columns
    sizes = counts.select("length", (F.floor(F.sqrt("n")) + 1).alias("buckets"))
    mixed = F.xxhash64(*[c for c in columns if c != "length"])
    dealt = pieces.join(F.broadcast(sizes), "length").withColumn("bucket", F.pmod(mixed, F.col("buckets")))
    # Buckets of one length follow each other; there are no more of them than rows in a bucket.
    held = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = cut_lineage(held.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift")))
    own = Window.partitionBy("length", "bucket").orderBy(*[c for c in columns if c != "length"])
    ranked = dealt.withColumn("own", F.row_number().over(own) - 1)
    return ranked.join(shifts, ["length", "bucket"]).select(*columns, (F.col("own") + F.col("shift")).alias("rank"))


def place(ranked: DataFrame, matches: list[Match]) -> DataFrame:
    """Replace ``rank`` by ``sequence_id`` and ``offset``. The matched runs are bounded by the capacity."""
    by_length: dict[int, tuple[np.ndarray, ...]] = {}
    for length in {m.length for m in matches}:
        own = sorted((m for m in matches if m.length == length), key=lambda m: m.rank)
        by_length[length] = tuple(np.array([getattr(m, f) for m in own]) for f in ("rank", "each", "sequence", "offset"))
    fields = ranked.schema.fields
    at, length_at = len(fields) - 1, ranked.columns.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranks, lengths = batch.column(at).to_numpy(), batch.column(length_at).to_numpy()
            sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for length in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == length)
                first, each, base, begin = by_length[length]
                run_of = np.searchsorted(first, ranks[rows], side="right") - 1
                inside = ranks[rows] - first[run_of]
                sequence[rows] = base[run_of] + inside // each[run_of]
                offset[rows] = begin[run_of] + inside % each[run_of] * length
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:at], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:at], "sequence_id", "offset"]
            )

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields[:at])
    return ranked.mapInArrow(run, f"{kept}, sequence_id long, offset long")


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Every piece with its place: the columns of ``token_pieces``, sequence_id and offset. Runs jobs."""
    pieces = cut_lineage(token_pieces(docs, tokenizer, capacity, end_id, id_col, text_col, with_ids))
    # One row for each length: bounded by the capacity.
    counts = cut_lineage(pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")))
    return place(rank_in_length(pieces, counts), best_fit(counts, capacity))
