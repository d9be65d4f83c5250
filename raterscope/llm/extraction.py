"""Main text of web pages by a recurrent labeller of blocks.

A page is the sequence of its text blocks (``html_blocks``). A block is a vector: its tag path, hashed (elements, the words
of their classes and ids, the innermost ones once more by themselves), its words, hashed, and some figures such as
length and share of linked text. A bidirectional LSTM reads the sequence, so that every block is judged within the whole page, and
a logistic unit on both states labels it as article or not. The text is what is labelled article.

The labeller is trained here, in one task, on a bounded sample: ``DRAWN`` drawn pages with known articles
(``page_layouts``), filled with words of the ``SAMPLE`` pages with the least hashes of their ids, and those of the sample that name
their article by exactly one such element, learned with the element's name and again with elements and classes made neutral. Steps
and order are fixed, so a table gives the same labeller again.

Labelling needs no shuffle. Pages are padded together up to a bounded number of blocks; a longer page is read in
chunks whose states are carried on, in either direction, so memory holds one chunk and two short vectors a block.

Defined results: a null page is an empty one; a page without text has an empty text; repeated rows and null ids are pages of
their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_blocks import Block, read_blocks
from .page_layouts import drawn_page, material, told_by_markup
from .shingles import word_hashes
from .text import slices

SAMPLE = 300
DRAWN = 1200
HIDDEN = 24
EPOCHS = 16
PATH_BITS, WORD_BITS = 9, 8
_FIGURES = 14
WIDTH = (1 << PATH_BITS) + (1 << WORD_BITS) + _FIGURES
# Blocks labelled together, padding included: some 2 MB of gates for each direction.
_BLOCKS = 4096
_SLICE_BYTES = 1 << 20


def _place(token: str) -> int:
    return xxhash.xxh64_intdigest(token) & ((1 << PATH_BITS) - 1)


@lru_cache(maxsize=20_000)
def _places(path: tuple[str, ...], tokens: tuple[tuple[str, ...], ...]) -> tuple[int, ...]:
    """Hashed elements of a path, the words of their classes, and the three innermost elements by their place."""
    found = {_place(name) for name in path}
    found |= {_place(f"{i} {name}") for i, name in enumerate(reversed(path[-3:]))}
    found |= {_place("." + token) for own in tokens for token in own}
    return tuple(found)


# Bytes that are not parts of words become spaces.
_SPACED = bytes.maketrans(bytes([*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]), b" " * 32)
# Digits, capital letters, letters (all beyond ASCII among them) by byte.
_KINDS = np.zeros((256, 3), np.float32)
_KINDS[0x30:0x3A, 0] = _KINDS[0x41:0x5B, 1] = _KINDS[0x41:0x5B, 2] = _KINDS[0x61:0x7B, 2] = _KINDS[0x80:, 2] = 1
# Bytes of a block that are looked at for shares of kinds; its words are counted to the end.
_LOOK = 400


def vectors(blocks: list[Block], order: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """One row for each block. ``order`` and ``total``: where the blocks stand in their page, and how many it has."""
    n = len(blocks)
    found = np.zeros((n, WIDTH), np.float32)
    paths, words = 1 << PATH_BITS, 1 << WORD_BITS
    places = [_places(b.path, b.tokens) for b in blocks]
    found[np.repeat(np.arange(n), [len(p) for p in places]), [x for p in places for x in p]] = 1.0
    texts = [b.text.encode(errors="replace") for b in blocks]
    hashes, counts = word_hashes([t.translate(_SPACED) for t in texts])
    at = np.repeat(np.arange(n), counts) * words + (hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    # Logarithms of counts, of length one: neither many words nor one repeated word outweighs the path.
    spelled = np.log1p(np.bincount(at, minlength=n * words).reshape(n, words))
    found[:, paths : paths + words] = spelled / np.maximum(np.linalg.norm(spelled, axis=1, keepdims=True), 1e-6)
    heads = [t[:_LOOK] for t in texts]
    lengths = np.array([len(h) for h in heads])
    kinds = np.add.reduceat(_KINDS[np.frombuffer(b"".join(heads), np.uint8)], np.cumsum(lengths) - lengths) if n else np.zeros((0, 3))
    sizes = np.array([len(b.text) for b in blocks], np.float32)
    figures = found[:, paths + words :]
    figures[:, 0] = np.log1p(sizes) / 6
    figures[:, 1] = np.log1p(counts) / 4
    figures[:, 2] = np.minimum([b.linked for b in blocks] / sizes, 1.0)
    figures[:, 3] = [b.text[-1] in ".!?\"”»…" for b in blocks]
    figures[:, 4] = np.log1p([t.count(b",") + t.count(b";") for t in texts]) / 2
    figures[:, 5:8] = kinds / lengths[:, None]
    figures[:, 8] = ["©" in b.text for b in blocks]
    figures[:, 9] = ["|" in b.text or "·" in b.text or "»" in b.text for b in blocks]
    figures[:, 10] = np.array([len(b.path) for b in blocks]) / 10
    figures[:, 11] = 1.0 / (1 + order)
    figures[:, 12] = order / total
    figures[:, 13] = 1.0 / (total - order)
    return found


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Direction:
    """One LSTM: gates (in, forget, out, new) from the row, the state before, and a bias."""

    from_row: np.ndarray
    from_state: np.ndarray
    bias: np.ndarray

    @staticmethod
    def drawn(rng: np.random.Generator) -> Direction:
        bias = np.zeros(4 * HIDDEN, np.float32)
        bias[HIDDEN : 2 * HIDDEN] = 1.0  # remember at first
        small = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        return Direction(small(WIDTH, 4 * HIDDEN), small(HIDDEN, 4 * HIDDEN), bias)

    def run(self, gates: np.ndarray, state: tuple[np.ndarray, np.ndarray], keep: list | None = None) -> tuple[np.ndarray, tuple]:
        """States for each step of ``gates`` (step, page, gate), and the last; ``keep`` takes what learning needs."""
        steps, pages, _ = gates.shape
        found = np.empty((steps, pages, HIDDEN), np.float32)
        h, c = state
        for t in range(steps):
            z = gates[t] + h @ self.from_state
            s = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            before, c = c, f * c + i * g
            tanh_c = np.tanh(c)
            if keep is not None:
                keep.append((i, f, o, g, before, tanh_c, h))
            h = o * tanh_c
            found[t] = h
        return found, (h, c)

    def learn(self, keep: list, slope: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slopes at the gates and of ``from_state``, from the slope at every state, backwards through the steps."""
        steps, pages, _ = slope.shape
        at_gates = np.empty((steps, pages, 4 * HIDDEN), np.float32)
        from_state = np.zeros_like(self.from_state)
        dh, dc = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
        for t in range(steps - 1, -1, -1):
            i, f, o, g, before, tanh_c, h = keep[t]
            dh = dh + slope[t]
            dc = dc + dh * o * (1 - tanh_c**2)
            z = at_gates[t]
            z[:, :HIDDEN] = dc * g * i * (1 - i)
            z[:, HIDDEN : 2 * HIDDEN] = dc * before * f * (1 - f)
            z[:, 2 * HIDDEN : 3 * HIDDEN] = dh * tanh_c * o * (1 - o)
            z[:, 3 * HIDDEN :] = dc * i * (1 - g**2)
            from_state += h.T @ z
            dh, dc = z @ self.from_state.T, dc * f
        return at_gates, from_state

    def tables(self) -> list[np.ndarray]:
        return [self.from_row, self.from_state, self.bias]


def _start(pages: int) -> tuple[np.ndarray, np.ndarray]:
    return np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)


def _seats(lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Where each block of pages that are read together stands among (step, page), onward and from the last block on."""
    n, counts = len(lengths), np.array(lengths)
    page = np.repeat(np.arange(n), counts)
    step = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return step * n + page, (counts[page] - 1 - step) * n + page


def _placed(values: np.ndarray, at: np.ndarray, pages: int) -> np.ndarray:
    """Rows of blocks as (step, page, ...); padding comes behind a page's last block, where nothing is read."""
    steps = int(at.max()) // pages + 1
    found = np.zeros((steps * pages, values.shape[1]), np.float32)
    found[at] = values
    return found.reshape(steps, pages, -1)


class Labeller:
    """Both directions and the unit on their states."""

    def __init__(self, onward: Direction, back: Direction, unit: np.ndarray):
        self.onward, self.back, self.unit = onward, back, unit

    @staticmethod
    def drawn(seed: int) -> Labeller:
        rng = np.random.default_rng(seed)
        return Labeller(Direction.drawn(rng), Direction.drawn(rng), np.zeros(2 * HIDDEN + 1, np.float32))

    def tables(self) -> list[np.ndarray]:
        return [*self.onward.tables(), *self.back.tables(), self.unit]

    def dump(self) -> bytes:
        return np.concatenate([t.ravel() for t in self.tables()]).astype(np.float32).tobytes()

    @staticmethod
    def load(data: bytes) -> Labeller:
        found, values, at = Labeller.drawn(0), np.frombuffer(data, np.float32), 0
        for table in found.tables():
            table[...] = values[at : at + table.size].reshape(table.shape)
            at += table.size
        return found

    def label_short(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Whether each block is of the article, for pages read together."""
        seat, turned = _seats([len(p) for p in pages])
        lengths = np.array([len(p) for p in pages])
        order = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        rows = vectors([b for p in pages for b in p], order, np.repeat(lengths, lengths))
        states = [
            own.run(_placed(rows @ own.from_row + own.bias, at, len(pages)), _start(len(pages)))[0].reshape(-1, HIDDEN)[at]
            for own, at in ((self.onward, seat), (self.back, turned))
        ]
        margins = np.concatenate(states, axis=1) @ self.unit[:-1] + self.unit[-1]
        return np.split(margins > 0, np.cumsum(lengths)[:-1])

    def label_long(self, blocks: list[Block]) -> np.ndarray:
        """The same for one page of any length, chunk by chunk."""
        n, margins = len(blocks), np.full(len(blocks), self.unit[-1], np.float32)
        chunks = [(a, min(a + _BLOCKS, n)) for a in range(0, n, _BLOCKS)]
        state = _start(1)
        for a, b in chunks:
            gates = vectors(blocks[a:b], np.arange(a, b), n) @ self.onward.from_row + self.onward.bias
            found, state = self.onward.run(gates[:, None], state)
            margins[a:b] += found[:, 0] @ self.unit[:HIDDEN]
        state = _start(1)
        for a, b in reversed(chunks):
            gates = vectors(blocks[a:b], np.arange(a, b), n) @ self.back.from_row + self.back.bias
            found, state = self.back.run(gates[::-1, None], state)
            margins[a:b] += (found[:, 0] @ self.unit[HIDDEN:-1])[::-1]
        return margins > 0

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        found: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        group: list[int] = []
        for i in [*sorted(range(len(pages)), key=lambda i: len(pages[i])), None]:
            longest = None if i is None else len(pages[i])
            if group and (longest is None or (len(group) + 1) * longest > _BLOCKS):
                for j, labels in zip(group, self.label_short([pages[j] for j in group]), strict=True):
                    found[j] = labels
                group = []
            if longest and longest > _BLOCKS:
                found[i] = self.label_long(pages[i])
            elif longest:
                group.append(i)
        return found


def fit(pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = EPOCHS, seed: int = 42, together: int = 24) -> Labeller:
    """Mean log loss over blocks by Adam; pages of similar length are learned together."""
    model, rng = Labeller.drawn(seed), np.random.default_rng(seed)
    tables = model.tables()
    first, second = [np.zeros_like(t) for t in tables], [np.zeros_like(t) for t in tables]
    order = sorted(range(len(pages)), key=lambda i: len(pages[i]))
    groups = [order[i : i + together] for i in range(0, len(order), together)]
    step, steps = 0, max(epochs * len(groups), 1)
    for _ in range(epochs):
        for at in rng.permutation(len(groups)).tolist():
            own = groups[at]
            rows = np.concatenate([pages[i] for i in own])
            truth = np.concatenate([labels[i] for i in own])
            states, kept, sides = [], [], list(zip((model.onward, model.back), _seats([len(pages[i]) for i in own]), strict=True))
            for side, seat in sides:
                kept.append([])
                found, _ = side.run(_placed(rows @ side.from_row + side.bias, seat, len(own)), _start(len(own)), kept[-1])
                states.append(found.reshape(-1, HIDDEN)[seat])
            both = np.concatenate(states, axis=1)
            error = (_sigmoid(both @ model.unit[:-1] + model.unit[-1]) - truth) / len(truth)
            grads = []
            for (side, seat), keep, weights in zip(sides, kept, (model.unit[:HIDDEN], model.unit[HIDDEN:-1]), strict=True):
                at_gates, from_state = side.learn(keep, _placed(error[:, None] * weights, seat, len(own)))
                flat = at_gates.reshape(-1, 4 * HIDDEN)[seat]
                grads += [rows.T @ flat, from_state, flat.sum(axis=0)]
            grads.append(np.concatenate([error @ both, [error.sum()]]))
            step += 1
            rate = 0.01 * (1 - 0.9 * step / steps)
            norm = float(np.sqrt(sum((g**2).sum() for g in grads)))
            for table, grad, a, b in zip(tables, grads, first, second, strict=True):
                grad = grad * min(1.0, 1.0 / max(norm, 1e-12))
                a += 0.1 * (grad - a)
                b += 0.001 * (grad**2 - b)
                table -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return model


def _neutral(blocks: list[Block]) -> list[Block]:
    """The blocks of a page whose telling elements and classes are made plain."""
    plain = {"article", "main", "nav", "header", "footer", "aside", "section", "form"}
    return [Block(b.text, tuple("div" if n in plain else n for n in b.path), tuple(() for _ in b.tokens), b.linked) for b in blocks]


def train_on(pages: list[str], drawn: int = DRAWN, epochs: int = EPOCHS) -> Labeller:
    """The labeller learned from a sample of pages and from pages drawn with their words."""
    words, sentences = material(pages)
    rows, labels, rng = [], [], np.random.default_rng(drawn)

    def learn(blocks: list[Block], told: list[int]) -> None:
        own = vectors(blocks, np.arange(len(blocks)), len(blocks))
        # Of every third block the words are unknown: what is around it has to tell.
        own[rng.random(len(own)) < 1 / 3, 1 << PATH_BITS : (1 << PATH_BITS) + (1 << WORD_BITS)] = 0
        rows.append(own)
        labels.append(np.array(told, np.float32))

    for seed in range(drawn):
        _, blocks, told = drawn_page(seed, words, sentences)
        if blocks:
            learn(blocks, told)
    for i, page in enumerate(pages):
        blocks = read_blocks(page)
        told = told_by_markup(page, blocks)
        if blocks and told is not None and len(blocks) <= 200:
            learn(_neutral(blocks) if i % 4 == 0 else blocks, told)
    return fit(rows, labels, epochs)


def train(table: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE) -> Labeller:
    """``train_on`` in one task, on at most ``sample`` pages and the first 64 KB of each. Runs jobs.

    The draw is made on ids alone; only the drawn ids then meet their pages, and of rows with the same id one is used.
    """
    order = F.xxhash64(_named(id_col).cast("string"))
    # A share of the hash range that holds about twice the sample: what is sorted stays bounded.
    share = min(1.0, 2 * sample / max(table.count(), 1))
    keys = table.select(order.alias("key")).filter(F.col("key") <= F.lit(min(int(share * 2**64) - 2**63, 2**63 - 1)))
    keys = keys.distinct().orderBy("key").limit(sample)
    pages = table.select(order.alias("key"), F.substring(_named(html_col).cast("string"), 1, 1 << 16).alias("page"))
    # ``sample`` keys: bounded by that parameter.
    drawn = pages.filter("page is not null").join(F.broadcast(keys), "key").groupBy("key").agg(F.min("page").alias("page"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pages = sorted(p for batch in batches for p in batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([train_on(pages).dump()], pa.binary())], ["model"])

    found = drawn.select("page").coalesce(1).mapInArrow(run, "model binary").first()
    return Labeller.load(bytes(found["model"]))


def _named(column: str):
    return F.col("`" + column.replace("`", "``") + "`")


def main_text(blocks: list[Block], labels: np.ndarray) -> str:
    return "\n".join(b.text for b, own in zip(blocks, labels.tolist(), strict=True) if own)


def _extract(model: Labeller, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "html", _SLICE_BYTES):
        pages = [read_blocks(p or "") for p in batch.column(0).to_pylist()]
        texts = [main_text(p, labels) for p, labels in zip(pages, model.label(pages), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[1:], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            [*batch.schema.names[1:], "text", "n_chars"],
        )


def extract(table: DataFrame, model: Labeller, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The id, url, ``text`` and ``n_chars`` of every page. No shuffle."""
    kinds = [table.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    rows = table.select(_named(html_col).cast("string").alias("html"), _named(id_col).alias("id"), _named(url_col).alias("url"))
    found = rows.mapInArrow(partial(_extract, model), f"id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
    return found.toDF(id_col, url_col, "text", "n_chars")
