"""Document fingerprints: Merkle trees over sections, paragraphs and clauses.

A text is cut without loss: sections end at blank lines, paragraphs at line ends, and leaves are clauses
(up to a mark such as ``.`` or ``,``; very long ones are cut after words that their own hash chooses, so that
an edit moves no other cut). Every node is the BLAKE2b hash of its children, so equal roots mean equal
texts, and two trees are compared from the top: equal nodes are skipped, differing ones are entered,
which locates the edit. The fingerprint is the tree as text::

    root|section:paragraph=leaf+length,leaf+length;paragraph=...|section:...

with 128 bits for the root and 32 for the other nodes, and each leaf's length in code points. The
likeness of two fingerprints is the share of their characters in leaves that both have (twice the
common characters over all characters), counted as multisets; it is 1 if the roots are equal.

Neighbours: ``fingerprints_with_next`` compares each text with the one after it in descending id order.
The order is cut into id ranges of bounded size; each range is one task's sorted stream, followed by a
copy of the next range's first text, so a text meets its neighbour without a shuffle of pairs.

Defined results: null counts as empty; an empty text has the root of no sections, and two empty ones are
alike (1); rows with equal ids are ordered by their text's hash; null ids come last; the last text's
neighbour is the first one, which is itself in a table of one; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

_SECTION = re.compile(r".*?\n[ \t]*\n+|.+\Z", re.DOTALL)
_PARAGRAPH = re.compile(r"[^\n]*\n+|[^\n]+")
_LEAF = re.compile(r"[^.!?,;:\n]*[.!?,;:\n]+\s*|[^.!?,;:\n]+")
_LONG = 160
_WORD = re.compile(r"\s*\S{1,80}")
# Bytes of text of one id range.
RANGE_BYTES = 4 << 20
# Ranges at most: their borders and first ids pass through the driver. Beyond a terabyte ranges grow instead.
MAX_RANGES = 1 << 18
_OUT_ROWS = 500


def _hash(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _leaves(paragraph: str) -> Iterator[str]:
    for clause in _LEAF.findall(paragraph):
        if len(clause) <= _LONG:
            yield clause
            continue
        # About every eighth word ends a piece; the text after the last word goes with it.
        begin = end = 0
        for word in _WORD.finditer(clause):
            end = word.end()
            if _hash(word[0].strip().encode())[0] < 32:
                yield clause[begin:end]
                begin = end
        if begin < len(clause):
            yield clause[begin:]


def fingerprint(text: str) -> str:
    """The text's tree."""
    sections, roots = [], []
    for section in _SECTION.findall(text):
        paragraphs, nodes = [], []
        for paragraph in _PARAGRAPH.findall(section):
            leaves = list(_leaves(paragraph))
            hashes = [_hash(leaf.encode()) for leaf in leaves]
            node = _hash(b"".join(hashes))
            nodes.append(node)
            shown = ",".join([f"{h[:4].hex()}+{len(leaf)}" for h, leaf in zip(hashes, leaves)])
            paragraphs.append(f"{node[:4].hex()}={shown}")
        node = _hash(b"".join(nodes))
        roots.append(node)
        sections.append(f"{node[:4].hex()}:{';'.join(paragraphs)}")
    return "|".join([_hash(b"".join(roots)).hex(), *sections])


def root(print_: str) -> str:
    return print_.partition("|")[0]


def _weights(print_: str) -> Counter:
    weights: Counter = Counter()
    for section in print_.split("|")[1:]:
        for paragraph in section.partition(":")[2].split(";"):
            weights.update(paragraph.partition("=")[2].split(","))
    return weights


def likeness(one: str, other: str) -> float:
    """Share of characters in common leaves, from 0 to 1."""
    return _likeness(one, other, _weights(one), _weights(other))


def _likeness(one: str, other: str, a: Counter, b: Counter) -> float:
    if root(one) == root(other):
        return 1.0
    total = _characters(a) + _characters(b)
    if len(b) < len(a):
        a, b = b, a
    common = sum(int(leaf.partition("+")[2]) * min(n, b[leaf]) for leaf, n in a.items() if leaf in b)
    return 2.0 * common / total if total else 0.0


def _characters(weights: Counter) -> int:
    return sum(int(leaf.partition("+")[2]) * n for leaf, n in weights.items())


def differences(one: str, other: str) -> list[tuple[int, int, int]]:
    """Where ``one`` has paragraphs that ``other`` lacks: (section, start, end) in code points.

    Sections and paragraphs whose hash the other tree has are skipped whole.
    """
    if root(one) == root(other):
        return []
    theirs = other.split("|")[1:]
    sections = Counter(s.partition(":")[0] for s in theirs)
    paragraphs = Counter(p.partition("=")[0] for s in theirs for p in s.partition(":")[2].split(";"))
    found, at = [], 0
    for number, section in enumerate(one.split("|")[1:]):
        name, _, rest = section.partition(":")
        known = sections[name] > 0
        sections[name] -= known
        for paragraph in rest.split(";"):
            node, _, leaves = paragraph.partition("=")
            length = sum(int(leaf.partition("+")[2]) for leaf in leaves.split(","))
            if not known:
                if paragraphs[node] > 0:
                    paragraphs[node] -= 1
                else:
                    found.append((number, at, at + length))
            at += length
    return found


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by as much of the beginning of the following one."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, n_chars and fingerprint of every text. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([fingerprint(t) for t in texts], pa.string())],
                [id_col, "n_chars", "fingerprint"],
            )

    narrow = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return narrow.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_chars long, fingerprint string")


def _range_of(borders: list[float]) -> Column:
    """Number of the id range, in descending order; null ids are in the last."""
    rising = np.array(borders)

    @F.pandas_udf("int")
    def number(ids: pd.Series) -> pd.Series:
        places = len(rising) - np.searchsorted(rising, ids.to_numpy(dtype="float64", na_value=-np.inf), side="right")
        return pd.Series(places)

    return number


def _streams(docs: DataFrame, id_col: str, text_col: str, range_bytes: int) -> DataFrame:
    """Every text with its range, each range sorted and closed by the text that follows it. Runs jobs."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    n = min(MAX_RANGES, max(1, -(-total // range_bytes)))
    borders = []
    if n > 1:
        wanted = [i / n for i in range(1, n)]
        borders = sorted(set(rows.filter(F.col("id").isNotNull()).approxQuantile("id", wanted, 1 / (4 * n))))
    range_of = _range_of(borders)
    keyed = rows.select("id", F.xxhash64("text").alias("hash"), range_of(F.col("id").cast("double")).alias("range"), "text")
    # The first text of each range, by narrow rows: at most one for each range comes to the driver.
    nulls_last = F.struct(F.col("id").isNotNull().alias("known"), "id", "hash")
    heads = keyed.groupBy("range").agg(F.max(nulls_last).alias("head")).orderBy("range").collect()
    closing = [(h["range"], after["head"]["id"], after["head"]["hash"]) for h, after in zip(heads, heads[1:] + heads[:1])]
    id_type = rows.schema["id"].dataType.simpleString()
    wanted = docs.sparkSession.createDataFrame(closing, f"closes int, id {id_type}, hash long")
    found = keyed.drop("range").join(F.broadcast(wanted.withColumnsRenamed({"id": "id2", "hash": "hash2"})),
                                     F.col("id").eqNullSafe(F.col("id2")) & (F.col("hash") == F.col("hash2")))
    # Equal rows are equally good; one of them closes the range.
    found = cut_lineage(found.groupBy("closes", "id", "hash").agg(F.first("text").alias("text")))
    closed = found.select("id", "hash", F.col("closes").alias("range"), "text", F.lit(1).alias("closing"))
    both = keyed.withColumn("closing", F.lit(0)).unionByName(closed)
    tasks = max(1, n // 8)
    return both.repartition(tasks, "range").sortWithinPartitions("range", "closing", F.desc_nulls_last("id"), F.desc("hash"))


def fingerprints_with_next(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """Fingerprints of every text and of its edited form (``edited``, with the next text in descending id order).

    The id, which must be a number; n_chars; edited_sha256; fingerprint; edited_fingerprint; near_edited and near_next, the
    likeness to the edited text's and to the next text's fingerprint. Runs jobs; the texts are shuffled once.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    fields = [
        ("n_chars", pa.int64()),
        ("edited_sha256", pa.string()),
        ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()),
        ("near_next", pa.float64()),
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[pa.Array] = []
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            arrays = [pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields, strict=True)]
            return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), *arrays], [id_col, *(n for n, _ in fields)])

        held = None
        for batch in batches:
            column = batch.column(0)
            for place, (text, closing) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                own = fingerprint(text)
                leaves = _weights(own)
                if held is not None:
                    at, before, print_, weights = held
                    changed = edited(before, text)
                    # Very often the next text supplies nothing, or the edit undoes itself.
                    other = print_ if changed == before else fingerprint(changed)
                    ids.append(at)
                    rows.append(
                        (
                            len(before),
                            hashlib.sha256(changed.encode()).hexdigest(),
                            print_,
                            other,
                            _likeness(print_, other, weights, _weights(other)),
                            _likeness(print_, own, weights, leaves),
                        )
                    )
                    if len(rows) >= _OUT_ROWS:
                        yield out()
                        ids, rows = [], []
                held = None if closing else (column.slice(place, 1), text, own, leaves)
        if rows:
            yield out()

    schema = (
        f"`{id_col}` {id_type}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    return _streams(docs, id_col, text_col, range_bytes).select("id", "text", "closing").mapInArrow(run, schema)
