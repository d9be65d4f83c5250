"""Toxicity by a counterfactual-regularised classifier.

A text is a set of hashed features: its words, and the beginnings of its words (three to six letters),
which carry over to inflected forms. The score is a logistic function of the sum of their weights.

Counterfactuals: in every labelled sentence that names a group, the name is swapped for those of other
groups, and the model is penalised for the square of the change of the score. For a linear score
that is the difference of the feature sets times the weights, so words for groups end up with equal,
small weights, and neutral mentions do not count as toxic.

Fitting: at most ``MAX_ROWS`` labelled rows, drawn by a hash of their id so that the draw does not
depend on order or partitioning, half of them toxic where there are enough. Everything else covers all
texts whole. An L1 term drops weights that the labels do not support, so that a very long text does not
add up noise.

Defined results: a null text is empty and has the score of no features; null, negative and out of range
labels are no labels; an id with several labels is toxic if any is; ids that are null have no labels;
repeated rows each get a score; without labelled rows of both classes every score is the prior (0 with
no rows at all); columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .text import alphanumeric_words, byte_texts, slices

# Rows that the classifier is fitted on at most.
MAX_ROWS = 12_000
FEATURE_BITS = 20
PREFIXES = (3, 4, 5, 6)
_SLICE_BYTES = 1 << 20
# Threshold of the predicted label.
THRESHOLD = 0.5

# Names of groups, by the kind of group: each is swapped for the others of its kind.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "females", "males"),
    ("woman", "man", "girl", "boy", "female", "male"),
    ("gay", "straight", "lesbian", "bisexual", "heterosexual", "homosexual", "transgender", "trans", "queer"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "protestants"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant"),
    ("black", "white", "asian", "latino", "african", "european", "arab", "indigenous"),
    ("immigrants", "natives", "foreigners", "refugees", "citizens"),
    ("mexican", "chinese", "german", "french", "spanish", "turkish", "polish", "indian"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "hindus"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "hindous"),
    ("mujeres", "hombres", "chicas", "chicos"),
    ("musulmanes", "cristianos", "judíos", "hindúes"),
)


@lru_cache(maxsize=1)
def _swaps() -> dict[bytes, tuple[bytes, ...]]:
    swaps: dict[bytes, tuple[bytes, ...]] = {}
    for kind in IDENTITY_TERMS:
        coded = [t.encode() for t in kind]
        for term in coded:
            swaps[term] = tuple(t for t in coded if t != term)
    return swaps


_MASK = (1 << FEATURE_BITS) - 1
_known: dict[bytes, tuple[int, ...]] = {}


def word_features(word: bytes) -> tuple[int, ...]:
    """Hashed features of a word: itself, and its beginnings in characters."""
    letters = word.decode(errors="replace")
    begins = [b"^" + letters[:n].encode() for n in PREFIXES if n <= len(letters)]
    return tuple([xxhash.xxh64_intdigest(p) & _MASK for p in (word, *begins)])


def _feature_set(words: set[bytes]) -> set[int]:
    fresh = words.difference(_known)
    if fresh:
        if len(_known) + len(fresh) > 100_000:
            _known.clear()
            fresh = words
        _known.update({w: word_features(w) for w in fresh})
    return set().union(*map(_known.__getitem__, words))


def features(text: bytes) -> np.ndarray:
    """Sorted hashed features of a text."""
    found = _feature_set(set(alphanumeric_words(text)))
    return np.sort(np.fromiter(found, np.int32, len(found)))


def counterfactuals(text: bytes) -> list[tuple[tuple[int, ...], tuple[int, ...]]]:
    """For each group that the text names, and each other one: features that the swap takes and brings.

    Features that the rest of the text has as well stay, so they are in neither list.
    """
    words = set(alphanumeric_words(text))
    swaps = _swaps()
    named = words.intersection(swaps)
    found = []
    for term in sorted(named):
        rest = _feature_set(words - {term})
        old = set(word_features(term)) - rest
        for other in swaps[term]:
            new = set(word_features(other)) - rest
            if old != new:
                found.append((tuple(sorted(old - new)), tuple(sorted(new - old))))
    return found


class Model:
    """Weights of the features that matter, and the bias.

    For each word met, the weighted features it has are remembered: for most words there are none.
    """

    WORDS = 100_000

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float):
        self.keys, self.weights, self.bias = keys, weights, bias
        self._weight = dict(zip(keys.tolist(), weights.tolist(), strict=True))
        self._weighted: dict[bytes, tuple[int, ...]] = {}

    def __reduce__(self):
        return Model, (self.keys, self.weights, self.bias)

    def forget(self) -> None:
        """Drop the remembered words: the worker that ran a task goes on to other work."""
        self._weighted.clear()

    def score(self, text: bytes) -> float:
        words = set(alphanumeric_words(text))
        known = self._weighted
        fresh = words.difference(known)
        if fresh:
            if len(known) + len(fresh) > self.WORDS:
                known.clear()
                fresh = words
            weight = self._weight
            known.update({w: tuple([f for f in word_features(w) if f in weight]) for w in fresh})
        found = set().union(*filter(None, map(known.__getitem__, words)))
        total = self.bias + sum(self._weight[f] for f in sorted(found))
        return float(1 / (1 + np.exp(-np.clip(total, -500, 500))))


class Rows:
    """Sparse rows of ones: the features of each row, one after the other."""

    def __init__(self, rows: list[np.ndarray], columns: np.ndarray):
        self.lengths = np.array([len(r) for r in rows], np.int64)
        self.columns = np.searchsorted(columns, np.concatenate([np.zeros(0, np.int64), *rows]))
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])

    def dot(self, weights: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(weights[self.columns])])
        return sums[self.starts[1:]] - sums[self.starts[:-1]]

    def transposed_dot(self, values: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.columns, np.repeat(values, self.lengths), size)


def fit(texts: list[bytes], toxic: list[int], **settings) -> Model:
    """``fit_features`` on the given texts."""
    return fit_features([features(t) for t in texts], [p for t in texts for p in counterfactuals(t)], toxic, **settings)


def fit_features(
    rows: list[np.ndarray],
    pairs: list[tuple[tuple[int, ...], tuple[int, ...]]],
    toxic: list[int],
    l1: float = 2e-5,
    l2: float = 1e-6,
    counterfactual: float = 1.0,
    least_rows: int = 3,
    least_chi2: float = 10.83,
    steps: int = 500,
) -> Model:
    """From the features of each text and the counterfactuals of all, minimise mean log loss + l1 |w| + l2 |w|^2 / 2 + counterfactual * mean squared change of the score.

    By accelerated proximal gradient steps, each feature scaled by how often it occurs. Features in
    fewer than ``least_rows`` rows are left out, and so are those that are not tied to the label at the
    level of one in a thousand (``least_chi2``, of the two-by-two table of feature and label).
    """
    labels = np.array(toxic, np.float64)
    if not len(labels):
        return Model(np.zeros(0, np.int64), np.zeros(0), -np.inf)
    if labels.min() == labels.max():
        rate = (labels.sum() + 0.5) / (len(labels) + 1)
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(rate / (1 - rate))))
    counts, among_toxic = np.zeros((2, _MASK + 1))
    for row, label in zip(rows, toxic, strict=True):
        counts[row] += 1
        among_toxic[row] += label
    n, positive = len(labels), labels.sum()
    apart = (among_toxic * (n - positive) - (counts - among_toxic) * positive) ** 2 * n
    chi2 = apart / np.maximum(counts * (n - counts) * positive * (n - positive), 1)
    used = (counts >= least_rows) & (chi2 >= least_chi2)
    columns = np.flatnonzero(used)
    rows = [r[used[r]] for r in rows]
    table = Rows(rows, columns)
    keep = lambda side: np.array([f for f in side if len(columns) and columns[min(np.searchsorted(columns, f), len(columns) - 1)] == f], np.int64)
    lost, won = Rows([keep(a) for a, _ in pairs], columns), Rows([keep(b) for _, b in pairs], columns)
    size, n = len(columns), len(labels)
    # Both classes weigh the same, whatever their share of the rows.
    share = labels.mean()
    row_weight = np.where(labels > 0, 0.5 / share, 0.5 / (1 - share)) / n
    frequency = np.bincount(table.columns, np.repeat(row_weight, table.lengths), size)
    # Step sizes: a diagonal bound on the curvature, from the rows' lengths and the feature's weight.
    reach = np.bincount(table.columns, np.repeat(row_weight * (table.lengths + 1), table.lengths), size)
    curve = 0.25 * reach + l2
    if pairs:
        length = lost.lengths + won.lengths
        for side in (lost, won):
            curve += 2 * counterfactual / len(pairs) * np.bincount(side.columns, np.repeat(length.astype(float), side.lengths), size)
    bias_curve = 0.25 * float((row_weight * (table.lengths + 1)).sum())
    weights = look = np.zeros(size)
    bias = look_bias = 0.0
    momentum = 1.0
    for _ in range(steps):
        error = (1 / (1 + np.exp(-np.clip(table.dot(look) + look_bias, -500, 500))) - labels) * row_weight
        slope = table.transposed_dot(error, size) + l2 * look
        if pairs:
            change = (won.dot(look) - lost.dot(look)) * (2 * counterfactual / len(pairs))
            slope += won.transposed_dot(change, size) - lost.transposed_dot(change, size)
        moved = look - slope / curve
        new = np.sign(moved) * np.maximum(np.abs(moved) - l1 * np.minimum(1.0, np.sqrt(frequency)) / curve, 0)
        new_bias = look_bias - error.sum() / bias_curve
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        pull = (momentum - 1) / after
        look, look_bias = new + pull * (new - weights), new_bias + pull * (new_bias - bias)
        weights, bias, momentum = new, new_bias, after
    held = weights != 0
    return Model(columns[held], weights[held], float(bias))


def _key(value) -> "F.Column":
    return F.crc32(value.cast("string").cast("binary"))


def held_out(ids) -> "F.Column":
    """Rows never learned from: crc32 of the id as text leaves no remainder by 5."""
    return F.coalesce(_key(ids) % 5 == 0, F.lit(False))


def training_rows(
    docs: DataFrame, labels: DataFrame, max_rows: int, id_col: str, text_col: str, label_col: str
) -> DataFrame:
    """Labelled rows to learn from: text and label, at most ``max_rows``, half of each class where there are enough.

    The draw is made on ids alone, by the order of a hash; only the drawn ids then meet their texts. Runs jobs.
    """
    labelled = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = labelled.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label"))
    known = cut_lineage(known.join(docs.select(F.col(id_col).alias("id")).distinct(), "id", "left_semi"))
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64(F.col("id").cast("string"))
    drawn = None
    for label in (1, 0):
        # A share of the hash range holds about a fifth more than wanted: what is sorted stays bounded.
        share = min(1.0, 1.2 * (max_rows // 2) / max(sizes.get(label, 0), 1))
        border = min(int(share * 2**64) - 2**63, 2**63 - 1)
        part = known.filter((F.col("label") == label) & (order <= F.lit(border)))
        part = part.orderBy(order, "id").limit(max_rows // 2)
        drawn = part if drawn is None else drawn.unionByName(part)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # max_rows ids: bounded by that parameter.
    joined = texts.join(F.broadcast(drawn), "id")
    return joined.groupBy("id", "label").agg(F.max("text").alias("text")).select("text", "label")


_HASHED = "digest binary, features array<int>, pairs array<struct<lost:array<int>,won:array<int>>>, label int"


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A digest to sort by, features, counterfactuals and label of each text."""
    side = pa.list_(pa.int32())
    pair = pa.struct([("lost", side), ("won", side)])
    for batch in slices(batches, "text", _SLICE_BYTES):
        texts = byte_texts(batch.column(0))
        pairs = [[{"lost": a, "won": b} for a, b in counterfactuals(t)] for t in texts]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([xxhash.xxh3_128_digest(t) for t in texts], pa.binary()),
                pa.array([features(t) for t in texts], side),
                pa.array(pairs, pa.list_(pair)),
                batch.column(1),
            ],
            ["digest", "features", "pairs", "label"],
        )
    _known.clear()


def train(
    docs: DataFrame,
    labels: DataFrame,
    max_rows: int = MAX_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> Model:
    """Fit the classifier in one task on the bounded sample. Runs jobs; the model comes to the driver.

    The model has at most as many weights as there are hashed features, whatever the table's size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Features stay in arrays: as Python's numbers they would be eight times as large.
        held = []
        for batch in batches:
            starts, flat = batch.column(1).offsets.to_numpy(), batch.column(1).values.to_numpy()
            rows = [flat[i:j].copy() for i, j in zip(starts, starts[1:])]
            held += zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), rows, batch.column(2).to_pylist(), strict=True)
        # The order of rows must not matter to the last digit.
        held.sort(key=lambda row: row[:2])
        pairs = [(tuple(p["lost"]), tuple(p["won"])) for row in held for p in row[3]]
        model = fit_features([row[2] for row in held], pairs, [row[1] for row in held])
        yield pa.RecordBatch.from_arrays(
            [pa.array([model.keys.tobytes()]), pa.array([model.weights.tobytes()]), pa.array([model.bias])], ["keys", "weights", "bias"]
        )

    rows = training_rows(docs, labels, max_rows, id_col, text_col, label_col)
    # Texts are hashed by many tasks; the one that fits holds their features.
    hashed = rows.select("text", F.col("label").cast("int").alias("label")).mapInArrow(_hashed, _HASHED)
    model = hashed.repartition(1).mapInArrow(run, "keys binary, weights binary, bias double").first()
    if model is None:
        return fit([], [])
    return Model(np.frombuffer(model["keys"], np.int64), np.frombuffer(model["weights"], np.float64), model["bias"])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, score and predicted label of every text. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", _SLICE_BYTES):
            scores = np.array([model.score(t) for t in byte_texts(batch.column(1))], np.float64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))], [id_col, "score", "predicted"]
            )
        model.forget()

    narrow = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return narrow.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, score double, predicted int")


def keep_civil(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The given table without the texts predicted toxic. Runs the jobs of ``train``."""
    model = train(docs, labels, max_rows, id_col, text_col)
    fields = docs.schema.fields
    place = docs.columns.index(text_col)
    plain = docs.toDF(*[f"c{i}" for i in range(len(fields))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, f"c{place}", _SLICE_BYTES):
            civil = [model.score(t) < THRESHOLD for t in byte_texts(batch.column(place).cast(pa.string()))]
            yield batch.filter(pa.array(civil, pa.bool_()))
        model.forget()

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
