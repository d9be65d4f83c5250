"""Benchmark decontamination with suffix arrays over the training texts.

The training texts are read in shards (slices of a partition). For each shard the words become numbers
and the suffixes of the word stream are sorted: a suffix array. Every suffix of every benchmark item is
then found in it by binary search, which gives all its verbatim matches; matches are lengthened to the
longest and kept with their places. No text is shuffled, and a benchmark larger than a stated size
is searched for in blocks, so that a task holds one shard and one block.

Two things keep the arrays small without losing a match. Words that no item has become one number that
matches nothing; and a suffix whose run of benchmark words is shorter than the shortest window cannot
hold a match that counts, so it is left out. Suffixes are ordered by as many words as a window has,
which is what the search compares; longer matches are read off from there.

Defined results: null has no words; a text or item without words matches nothing; an item of fewer words
than a window is one window; equal item ids are one item with several texts; repeated documents and
null ids keep their rows; items with a null id match but have no name to list; an empty benchmark hits
nothing; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .text import alphanumeric_words, byte_texts, slices

WINDOW = 13
# Text bytes of the benchmark that one block may hold; larger ones are searched for in several passes.
BLOCK_BYTES = 16 << 20
_SHARD_BYTES = 1 << 20


class Block:
    """The suffixes of some benchmark items, as numbers of their words."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        self.window = window
        self.numbers: dict[bytes, int] = {}
        self.names = [name for name, _ in items]
        texts = [alphanumeric_words(text) for _, text in items]
        coded = [[self.numbers.setdefault(w, len(self.numbers) + 1) for w in words] for words in texts]
        self.words = np.array([n for words in coded for n in [*words, 0]], np.uint32)
        lengths = np.array([len(words) for words in coded], np.int64)
        begins = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]) if len(coded) else np.zeros(0, np.int64)
        # Each suffix with at least a window of words, or the whole of a shorter item.
        self.place, self.item, self.reach = [], [], []
        for item, (begin, length) in enumerate(zip(begins.tolist(), lengths.tolist(), strict=True)):
            width = min(window, length)
            if width:
                count = length - width + 1
                self.place.append(np.arange(begin, begin + count))
                self.item.append(np.full(count, item))
                self.reach.append(np.full(count, width))
        empty = [np.zeros(0, np.int64)]
        self.place, self.item, self.reach = (np.concatenate(x or empty) for x in (self.place, self.item, self.reach))
        self.shortest = int(self.reach.min()) if len(self.reach) else 0


def _keys(words: np.ndarray, places: np.ndarray, width: int) -> np.ndarray:
    """The next ``width`` words at each place as one comparable value; numbers are never 0 within a run."""
    padded = np.concatenate([words, np.zeros(width, np.uint32)])
    rows = padded[places[:, None] + np.arange(width)].astype(">u4")
    # After a word that matches nothing, the rest of a suffix does not matter.
    rows[np.cumsum(rows == 0, axis=1) > 0] = 0
    return np.ascontiguousarray(rows).view(f"S{4 * width}").ravel()


class SuffixArray:
    """Sorted suffixes of a shard's word stream (0: no benchmark word, or the end of a text)."""

    def __init__(self, words: np.ndarray, shortest: int, width: int):
        self.words, self.width = words, width
        inside = words != 0
        # Length of the run of benchmark words from each place on.
        stops = np.flatnonzero(~inside)
        following = np.searchsorted(stops, np.arange(len(words)))
        ends = np.append(stops, len(words))[following]
        self.run = ends - np.arange(len(words))
        places = np.flatnonzero(self.run >= max(shortest, 1))
        keys = _keys(words, places, width)
        order = np.argsort(keys, kind="stable")
        self.places, self.keys = places[order], keys[order]

    def find(self, words: np.ndarray, places: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """Interval of the array whose suffixes begin with ``reach`` words of each given suffix."""
        low = _keys(words, places, reach)
        # The same words followed by the smallest and by the largest continuation.
        tail = self.width - reach
        first = np.char.add(low, b"") if not tail else low
        begin = np.searchsorted(self.keys, first.astype(self.keys.dtype), side="left")
        if not tail:
            return begin, np.searchsorted(self.keys, first.astype(self.keys.dtype), side="right")
        raw = np.frombuffer(low.tobytes(), np.uint8).reshape(len(low), 4 * reach)
        last = np.concatenate([raw, np.full((len(low), 4 * tail), 255, np.uint8)], axis=1)
        last = np.ascontiguousarray(last).view(f"S{4 * self.width}").ravel()
        return begin, np.searchsorted(self.keys, last, side="right")


def _matches(array: SuffixArray, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All matches of at least a window: place in the stream, suffix number of the block, and length."""
    places, suffixes, lengths = [], [], []
    if not len(array.places):
        return (np.zeros(0, np.int64),) * 3
    for reach in np.unique(block.reach).tolist():
        chosen = np.flatnonzero(block.reach == reach)
        begin, end = array.find(block.words, block.place[chosen], reach)
        hit = np.flatnonzero(end > begin)
        count = (end - begin)[hit]
        if not len(hit):
            continue
        rows = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin[hit], count)
        at, suffix = array.places[rows], np.repeat(chosen[hit], count)
        # Lengthen to the longest verbatim match, word by word, as long as any still agrees.
        length = np.full(len(at), reach, np.int64)
        going = np.arange(len(at))
        stream = np.append(array.words, 0)
        while len(going):
            a, b = at[going] + length[going], block.place[suffix[going]] + length[going]
            same = (stream[np.minimum(a, len(stream) - 1)] == block.words[b]) & (block.words[b] != 0)
            going = going[same]
            length[going] += 1
        places.append(at)
        suffixes.append(suffix)
        lengths.append(length)
    if not places:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(places), np.concatenate(suffixes), np.concatenate(lengths)


_SPANS = pa.list_(pa.struct([("item", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("item_start", pa.int64())]))
_SPANS_SQL = "array<struct<item: string, start: long, end: long, item_start: long>>"


def _search(block: Block, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    width = int(block.reach.max()) if len(block.reach) else 1
    item_begin = np.zeros(len(block.names), np.int64)
    if len(block.item):
        firsts, index = np.unique(block.item, return_index=True)
        item_begin[firsts] = block.place[index]
    for batch in slices(batches, "text", _SHARD_BYTES):
        texts = [alphanumeric_words(t) for t in byte_texts(batch.column(batch.num_columns - 1))]
        counts = np.array([len(t) for t in texts], np.int64)
        begins = np.concatenate([[0], np.cumsum(counts + 1)[:-1]])
        spans: list[list] = [[] for _ in texts]
        number = block.numbers.get
        stream = np.zeros(int(counts.sum()) + len(texts), np.uint32)
        for begin, words in zip(begins.tolist(), texts, strict=True):
            stream[begin : begin + len(words)] = [number(w, 0) for w in words]
        if len(block.reach):
            array = SuffixArray(stream, block.shortest, width)
            places, suffixes, lengths = _matches(array, block)
            # A match whose left neighbours agree as well is part of the longer one that begins there.
            if len(places):
                before = np.where(places > 0, stream[places - 1], 0)
                left = block.words[block.place[suffixes] - 1]
                inner = (before == left) & (before != 0) & (block.place[suffixes] > item_begin[block.item[suffixes]])
                keep = ~(inner & (block.reach[suffixes] == block.window))
                places, suffixes, lengths = places[keep], suffixes[keep], lengths[keep]
            rows = np.searchsorted(begins, places, side="right") - 1
            for row, at, suffix, length in zip(rows.tolist(), (places - begins[rows]).tolist(), suffixes.tolist(), lengths.tolist(), strict=True):
                item = int(block.item[suffix])
                spans[row].append(
                    {"item": block.names[item], "start": at, "end": at + length, "item_start": int(block.place[suffix] - item_begin[item])}
                )
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array(counts), pa.array(spans, _SPANS)],
            [*batch.schema.names[:-1], "n_words", "matches"],
        )


def benchmark_blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_bytes: int) -> Iterator[Block]:
    """The items, read into the driver one block of bounded size after the other."""
    item, text = F.col(item_col).cast("string").alias("item"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    rows = benchmark.select(item, text)
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-total // block_bytes))
    for number in range(blocks):
        part = rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == number) if blocks > 1 else rows
        yield Block([(r["item"], r["text"].encode()) for r in part.collect()], window)


def _narrow(docs: DataFrame, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    """The columns to carry, under names of their own, and the text last."""
    named = lambda c: F.col("`" + c.replace("`", "``") + "`")
    kept = [named(c).alias(f"keep{i}") for i, c in enumerate(keep)]
    return docs.select(named(id_col).alias("id"), *kept, named(text_col).cast("string").alias("text"))


def _schema(df: DataFrame, *more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), *more])


def _matched(narrow: DataFrame, blocks: Iterator[Block], window: int) -> DataFrame:
    """The table with ``n_words`` and ``matches`` in place of the text."""
    rest = narrow.drop("text")
    spans = f"matches {_SPANS_SQL}"
    waiting = list(islice(blocks, 2))
    if len(waiting) == 1:
        return narrow.mapInArrow(partial(_search, waiting[0]), _schema(rest, "n_words long", spans))
    # Matches depend on the text alone: each block's are found by digest, and joined to all texts. They are
    # written before the next block is read, so that the driver holds two blocks at most.
    digest = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest")
    found = None
    while waiting:
        part = narrow.select(digest, "text").mapInArrow(partial(_search, waiting.pop(0)), f"digest binary, n_words long, {spans}")
        part = cut_lineage(part.filter(F.size("matches") > 0).groupBy("digest").agg(F.first("matches").alias("matches")))
        found = part if found is None else found.unionByName(part)
        waiting = waiting or list(islice(blocks, 1))
    merged = found.groupBy("digest").agg(F.array_distinct(F.flatten(F.collect_list("matches"))).alias("matches"))
    merged = cut_lineage(merged)
    addressed = narrow.select(*rest.columns, digest, "text")
    counted = addressed.mapInArrow(partial(_search, Block([], window)), _schema(addressed.drop("text"), "n_words long", spans))
    joined = counted.drop("matches").join(merged, "digest", "left")
    return joined.select(*rest.columns, "n_words", F.coalesce("matches", F.array().cast(_SPANS_SQL)).alias("matches"))


def find_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Verbatim matches of every text: the id, ``n_words`` and ``matches``.

    A match is (item, start, end, item_start) in words, as long as it can be; it has at least
    ``window`` words, or is a whole shorter item. If the benchmark needs several blocks, runs a job,
    and texts with equal content share their matches.
    """
    blocks = benchmark_blocks(benchmark, item_col, text_col, window, block_bytes)
    return _matched(_narrow(docs, id_col, text_col, []), blocks, window).withColumnRenamed("id", id_col)


def _summaries(ratio: int, column: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words = batch.column(column).to_pylist()
        hits, items, digests = [], [], []
        for spans in batch.column(column + 1).to_pylist():
            covered, upto = 0, 0
            for start, end in sorted((s["start"], s["end"]) for s in spans):
                covered += max(0, end - max(start, upto))
                upto = max(upto, end)
            named = sorted({s["item"] for s in spans if s["item"] is not None})
            hits.append(covered)
            items.append(len(named))
            digests.append(hashlib.sha256(",".join(named).encode()).hexdigest())
        bad = [h > 0 and ratio * h >= n for h, n in zip(hits, n_words, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[: column + 1], pa.array(hits, pa.int64()), pa.array(items, pa.int64()), pa.array(digests), pa.array(bad)],
            [*batch.schema.names[: column + 1], "n_hit", "n_items", "items_sha256", "contaminated"],
        )


def judge(matches: DataFrame, ratio: int = 20) -> DataFrame:
    """From ``find_matches``: words inside a match, the items matched, and whether the text is contaminated.

    Contaminated is a text of whose words at least one in ``ratio`` lies in a match.
    """
    fields = matches.schema.fields
    schema = _schema(matches.drop("matches"), "n_hit long, n_items long, items_sha256 string, contaminated boolean")
    return matches.mapInArrow(partial(_summaries, ratio, len(fields) - 2), schema)


def remove_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    ratio: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The given table without contaminated texts: the same columns, nulls included."""
    blocks = benchmark_blocks(benchmark, item_col, text_col, window, block_bytes)
    judged = judge(_matched(_narrow(docs, id_col, text_col, docs.columns), blocks, window), ratio)
    return judged.filter(~F.col("contaminated")).select(*[f"keep{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)
