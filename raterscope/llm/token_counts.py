"""Token counts by finite-state transducers, for byte-level BPE tokenizers.

Counting tokens needs no token ids, so the tokenizer is compiled into two deterministic transducers
whose transitions carry what they emit:

1. The splitter reads characters (by class: letter, digit, space, ...) and emits where words begin. It
   has 13 states. A stream of texts is cut into equal chunks; each chunk is run from every state at
   once, which gives its state map, and the maps are composed by a parallel prefix scan. So each
   chunk's entry state is known without reading the chunks before it one after the other.
2. The merger reads the bytes of a word and emits how many tokens each byte adds (or takes away: "th"
   may join what "t" had begun). Its states come from the vocabulary and the merge ranks alone and are
   made when first met. Words do not depend on each other, so every word begins in one start state and
   the map of a chunk that begins at a word is a constant; thousands of chunks advance in step.

Why the merger is finite: the encoding of a prefix ends in exactly one token whose pair with the token
before it survives the merge order (``_Merger._pair_stays``). To extend the prefix by a byte it is enough to
know, for each earlier position from which the bytes up to here still begin some token, the place in
the vocabulary's trie, the last token at that position, and how many tokens fewer it had. Such tuples
are the states; their number is bounded by the vocabulary, not by the texts.

Defined results: null counts as empty, an empty text has no tokens, repeated rows and null ids keep
their rows, an empty table gives an empty result, and columns other than the id and the text are not
read. Strings of special tokens inside a text are one token each, as in the library's default.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .text import byte_texts, slices

# Character classes of the splitter. The contraction letters have classes of their own.
_LETTER, _S, _R, _V, _L, _E, _DIGIT, _SPACE, _WHITE, _QUOTE, _OTHER, _END, _SPECIAL = range(13)
_LETTERS = (_LETTER, _S, _R, _V, _L, _E)
# States: at a boundary; in a run of letters, digits, others; one white character that is a space, or
# not; several whose last is a space, or not; after a quote that began a word; after 'r, 'v, 'l.
_B, _IN_L, _IN_D, _IN_O, _SP1, _WS1, _SPN, _WSN, _Q, _QR, _QV, _QL = range(12)
_STATES, _CLASSES = 12, 13
# Emissions: a word begins at this character, at the one before, or both.
_HERE, _BEFORE = 1, 2
_CHUNK = 512
_SLICE_BYTES = 4 << 20


def _fresh(kind: int) -> int:
    """State after the first character of a word."""
    if kind in _LETTERS:
        return _IN_L
    return {_DIGIT: _IN_D, _SPACE: _SP1, _WHITE: _WS1, _QUOTE: _Q, _OTHER: _IN_O}.get(kind, _B)


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and emission for every state and class.

    Words are contractions (a quote at a word's beginning and s, t, m, d, re, ve or ll), runs of letters,
    digits or others with a space before, and white space, whose last character goes to what follows.
    """
    step, emit = np.zeros((_STATES, _CLASSES), np.uint8), np.zeros((_STATES, _CLASSES), np.uint8)
    run = {_IN_L: _LETTERS, _IN_D: (_DIGIT,), _IN_O: (_QUOTE, _OTHER)}
    white = (_SPACE, _WHITE)
    for state in range(_STATES):
        for kind in range(_CLASSES):
            new, out = _fresh(kind), _HERE
            if kind in (_END, _SPECIAL):
                # The separator is a word of its own that emits nothing; a quote's letter stands alone.
                out |= _BEFORE if state in (_QR, _QV, _QL) else 0
            elif kind in run.get(state, ()):
                new, out = state, 0
            elif state in (_SP1, _WS1, _SPN, _WSN) and kind in white:
                new, out = (_SPN if kind == _SPACE else _WSN), 0
            elif state in (_SP1, _SPN):
                new, out = (_IN_O if kind == _QUOTE else _fresh(kind)), (_BEFORE if state == _SPN else 0)
            elif state == _WSN:
                out = _HERE | _BEFORE
            elif state == _Q and kind in (_QUOTE, _OTHER):
                new, out = _IN_O, 0
            elif state == _Q and kind == _S:
                new, out = _B, 0
            elif state == _Q and kind in (_R, _V, _L):
                new, out = {_R: _QR, _V: _QV, _L: _QL}[kind], 0
            elif (state in (_QR, _QV) and kind == _E) or (state == _QL and kind == _L):
                new, out = _B, 0
            elif state in (_QR, _QV, _QL):
                # No contraction after all: the quote was a word, and its letter began the next.
                new, out = (_IN_L, _BEFORE) if kind in _LETTERS else (_fresh(kind), _HERE | _BEFORE)
            step[state, kind], emit[state, kind] = new, out
    return step, emit


class _Merger:
    """The transducer over the bytes of a word, compiled as far as the texts need it.

    A state is a flat tuple of (trie node, last token there, tokens behind) for each live position.
    """

    # States kept at a time; when full the table is begun anew, which only costs time.
    ROWS = 1 << 18

    def __init__(self, tokens: dict[bytes, int], ranks: dict[tuple[bytes, bytes], int]):
        self.ranks = ranks
        self.pairs: dict[int, bool] = {}
        # Trie over the tokens: node and byte -> node, and the token that ends at a node (-1: none).
        # Tokens that the merges never make from their own bytes cannot occur and are left out.
        self.child: dict[int, int] = {}
        self.inner = [True]
        self.token = [-1]
        self.tokens = [t for t in tokens if self._merged(t) == [t]]
        for number, token in enumerate(self.tokens):
            node = 0
            for byte in token:
                self.inner[node] = True
                key = node << 8 | byte
                if key not in self.child:
                    self.child[key] = len(self.token)
                    self.token.append(-1)
                    self.inner.append(False)
                node = self.child[key]
            self.token[node] = number
        # Columns of the table: bytes get one when first met.
        self.width = 128
        self.column = np.full(256, -1, np.int64)
        self.bytes: list[int] = []
        self._reset()

    def _reset(self) -> None:
        self.states: list[tuple[int, ...]] = [(0, -1, 0)]
        self.numbers: dict[tuple[int, ...], int] = {self.states[0]: 0}
        self.next = np.full((1024, self.width), -1, np.int32)
        self.gain = np.zeros((1024, self.width), np.int8)

    def _merged(self, word: bytes) -> list[bytes]:
        """Plain byte-pair encoding: join the pair of lowest rank, the leftmost first."""
        parts = [word[i : i + 1] for i in range(len(word))]
        ranks = self.ranks
        while len(parts) > 1:
            found = [ranks.get(pair, 1 << 40) for pair in zip(parts, parts[1:])]
            best = min(found)
            if best == 1 << 40:
                break
            at = found.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _pair_stays(self, first: int, second: int) -> bool:
        """Whether the encoding of the two tokens' bytes is just these two tokens."""
        key = first << 32 | second
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > 1 << 20:
                self.pairs.clear()
            pair = [self.tokens[first], self.tokens[second]]
            known = self.pairs[key] = self._merged(pair[0] + pair[1]) == pair
        return known

    def extend(self, state: tuple[int, ...], byte: int) -> tuple[tuple[int, ...], int]:
        """The state after one more byte, and by how many tokens the count changes."""
        live, last, count = [], -1, 0
        child_of, token_at, inner = self.child, self.token, self.inner
        for i in range(0, len(state), 3):
            child = child_of.get(state[i] << 8 | byte)
            if child is None:
                continue
            before = state[i + 1]
            if last < 0:
                token = token_at[child]
                if token >= 0 and (before < 0 or self._pair_stays(before, token)):
                    last, count = token, state[i + 2] + 1
            if inner[child]:
                live += (child, before, state[i + 2])
        if last < 0:
            raise ValueError("the vocabulary lacks a token for a single byte")
        # Counts are kept relative to the newest position.
        for i in range(2, len(live), 3):
            live[i] -= count
        return (*live, 0, last, 0), count

    def number(self, state: tuple[int, ...]) -> int:
        known = self.numbers.get(state)
        if known is None:
            known = self.numbers[state] = len(self.states)
            self.states.append(state)
            if known >= len(self.next):
                more = len(self.next)
                self.next = np.concatenate([self.next, np.full((more, self.width), -1, np.int32)])
                self.gain = np.concatenate([self.gain, np.zeros((more, self.width), np.int8)])
        return known

    def columns(self, symbols: np.ndarray) -> np.ndarray:
        """Table columns of a stream's bytes."""
        for byte in np.flatnonzero(np.bincount(symbols, minlength=256) * (self.column < 0)).tolist():
            self.column[byte] = len(self.bytes)
            self.bytes.append(byte)
        if len(self.bytes) > self.width:
            self.width = 256
            self._reset()
        return self.column[symbols].astype(np.uint8)

    def compile(self, state: int, column: int) -> int:
        target, gain = self.extend(self.states[state], self.bytes[column])
        number = self.number(target)
        self.next[state, column], self.gain[state, column] = number, gain
        return number

    def count(self, symbols: np.ndarray, begins: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens that each byte adds. ``begins`` marks first bytes of words; each lane starts at one."""
        symbols = self.columns(symbols)
        added = np.zeros(len(symbols), np.int8)
        order = np.argsort(starts - ends, kind="stable")
        starts, lengths = starts[order], (ends - starts)[order]
        state = np.zeros(len(starts), np.int64)
        falling = -lengths
        for at in range(int(lengths[0]) if len(lengths) else 0):
            active = int(np.searchsorted(falling, -at, side="left"))
            if active <= 8:
                for lane in range(active):
                    self._finish(symbols, begins, added, int(state[lane]), int(starts[lane] + at), int(starts[lane] + lengths[lane]))
                break
            if len(self.states) > self.ROWS:
                kept = [self.states[s] for s in state[:active]]
                self._reset()
                state[:active] = [self.number(s) for s in kept]
            place = starts[:active] + at
            byte = symbols[place]
            current = np.where(begins[place], 0, state[:active])
            new = self.next[current, byte]
            missing = np.flatnonzero(new < 0)
            if len(missing):
                pairs = np.unique(current[missing] * 256 + byte[missing])
                for pair in pairs.tolist():
                    self.compile(pair >> 8, pair & 255)
                new = self.next[current, byte]
            added[place] = self.gain[current, byte]
            state[:active] = new
        return added

    def _finish(self, symbols, begins, added, state: int, start: int, end: int) -> None:
        """One lane alone: the rest of a very long word."""
        for place in range(start, end):
            if len(self.states) > self.ROWS:
                kept = self.states[state]
                self._reset()
                state = self.number(kept)
            byte = int(symbols[place])
            current = 0 if begins[place] else state
            state = int(self.next[current, byte])
            if state < 0:
                state = self.compile(current, byte)
            added[place] = self.gain[current, byte]


class Transducer:
    """A compiled tokenizer file (byte-level BPE with the usual word expression)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        model, splitter = described["model"], described["pre_tokenizer"]
        plain = described["normalizer"] is None and model["type"] == "BPE" and splitter["type"] == "ByteLevel"
        if not plain or splitter["add_prefix_space"] or not splitter["use_regex"] or model.get("ignore_merges"):
            raise ValueError("only byte-level BPE without normalizer can be compiled")
        # The printable stand-in of each byte, as the library maps it.
        alphabet = {}
        for byte in range(256):
            if byte < 128:
                alphabet[ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(byte))[0][0]] = byte
        names = sorted(ByteLevel.alphabet())
        high = self._high_bytes()
        for name in names:
            if name not in alphabet:
                alphabet[name] = high[name]
        as_bytes = lambda text: bytes(alphabet[c] for c in text)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ranks = {(as_bytes(a), as_bytes(b)): rank for rank, (a, b) in enumerate(merges)}
        specials = [t for t in described["added_tokens"]]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in specials):
            raise ValueError("special tokens that strip or depend on their neighbours cannot be compiled")
        contents = [t["content"] for t in specials]
        self.special = re.compile(b"|".join(re.escape(c.encode()) for c in sorted(contents, key=len, reverse=True))) if contents else None
        ordinary = {as_bytes(name): number for name, number in model["vocab"].items() if name not in contents}
        self.merger = _Merger(ordinary, ranks)
        self.step, self.emit = _splitter()
        # Classes of characters are asked of the library itself, so that its Unicode tables hold.
        self._tokenizer = Tokenizer.from_file(path)
        self.classes = np.full(0x110000, 255, np.uint8)
        for letter, kind in zip("stmdrvle", (_S, _S, _S, _S, _R, _V, _L, _E), strict=True):
            self.classes[ord(letter)] = kind
        self.classes[ord(" ")], self.classes[ord("'")] = _SPACE, _QUOTE

    @staticmethod
    def _high_bytes() -> dict[str, int]:
        """Stand-ins of the bytes from 128: those of the printable ones are themselves, the others follow in order."""
        printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        named = {chr(b): b for b in printable}
        rest = [b for b in range(256) if b not in set(printable)]
        return named | {chr(256 + i): b for i, b in enumerate(rest)}

    def _class_of(self, point: int) -> int:
        pieces = self._tokenizer.pre_tokenizer.pre_tokenize_str
        character = chr(point)
        if len(pieces("a" + character)) == 1:
            return _LETTER
        if len(pieces("1" + character)) == 1:
            return _DIGIT
        return _OTHER if len(pieces("!" + character)) == 1 else _WHITE

    def _stream(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All texts in one byte stream, each followed by an end mark; a special string is one mark too.

        The marks are bytes that UTF-8 never has: 0xFF ends a text, 0xFE is a special token.
        """
        if self.special is not None:
            texts = [self.special.sub(b"\xfe", t) if b"<" in t or self.special.search(t) else t for t in texts]
        stream = np.frombuffer(b"".join(t + b"\xff" for t in texts), np.uint8)
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        lead = np.flatnonzero((stream & 0xC0) != 0x80)
        # Code points, with U+0000 in place of the marks, which are put back as classes.
        decodable = stream.copy()
        marks = stream >= 0xFE
        decodable[marks] = 0
        points = np.frombuffer(decodable.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        kinds = self.classes[points]
        if (kinds == 255).any():
            for point in np.unique(points[kinds == 255]).tolist():
                self.classes[point] = self._class_of(point)
            kinds = self.classes[points]
        mark = stream[lead]
        kinds = np.where(mark == 0xFF, _END, np.where(mark == 0xFE, _SPECIAL, kinds)).astype(np.uint8)
        return stream, ends, lead, kinds, marks

    def _word_begins(self, kinds: np.ndarray) -> np.ndarray:
        """Characters at which words begin: chunk maps, their prefix scan, then the emissions."""
        chunks = -(-len(kinds) // _CHUNK)
        padded = np.full(chunks * _CHUNK, _END, np.uint8)
        padded[: len(kinds)] = kinds
        columns = np.ascontiguousarray(padded.reshape(chunks, _CHUNK).T)
        flat_step, flat_emit = self.step.ravel().astype(np.intp), self.emit.ravel()
        # Map of each chunk: the exit state for every entry state. Most maps are constant after a few
        # characters; only the others go on with all their states.
        maps = np.tile(np.arange(_STATES), (chunks, 1))
        open_rows = np.arange(chunks)
        settled_at = np.full(chunks, _CHUNK)
        exits = np.zeros(chunks, np.intp)
        for at in range(_CHUNK):
            maps[open_rows] = flat_step[maps[open_rows] * _CLASSES + columns[at, open_rows][:, None]]
            same = (maps[open_rows] == maps[open_rows][:, :1]).all(axis=1)
            done = open_rows[same]
            settled_at[done], exits[done] = at + 1, maps[done, 0]
            open_rows = open_rows[~same]
            if not len(open_rows):
                break
        for at in range(int(settled_at.min()) if chunks else 0, _CHUNK):
            run = np.flatnonzero(settled_at <= at)
            exits[run] = flat_step[exits[run] * _CLASSES + columns[at, run]]
        constant = settled_at < _CHUNK
        maps[constant] = exits[constant, None]
        # Inclusive prefix scan by doubling: afterwards row i maps the state before the stream to the
        # state after chunk i.
        reach = 1
        while reach < chunks:
            maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach].copy(), axis=1)
            reach *= 2
        state = np.concatenate([[_B], maps[:-1, _B]])
        emitted = np.empty((_CHUNK, chunks), np.uint8)
        for at in range(_CHUNK):
            place = state * _CLASSES + columns[at]
            emitted[at] = flat_emit[place]
            state = flat_step[place]
        out = emitted.T.ravel()[: len(kinds)]
        begins = (out & _HERE) > 0
        begins[:-1] |= (out[1:] & _BEFORE) > 0
        return begins

    def counts(self, texts: list[bytes]) -> np.ndarray:
        """Tokens of each text."""
        if not texts:
            return np.zeros(0, np.int64)
        stream, ends, lead, kinds, marks = self._stream(texts)
        begins = np.zeros(len(stream), bool)
        begins[lead] = self._word_begins(kinds)
        # Lanes run from the first word at or after each cut to that of the next; marks are skipped.
        words = np.flatnonzero(begins)
        cuts = np.searchsorted(words, np.arange(0, len(stream), _CHUNK))
        starts = np.unique(words[cuts[cuts < len(words)]])
        # A mark is a word of one symbol. It is read as a zero byte and its gain then overwritten.
        symbols = np.where(marks, 0, stream)
        added = self.merger.count(symbols, begins, starts, np.append(starts[1:], len(stream)))
        added[marks] = stream[marks] == 0xFE
        sums = np.concatenate([[0], np.cumsum(added, dtype=np.int64)])
        return sums[ends + 1] - sums[np.concatenate([[0], ends[:-1] + 1])]


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    """The compiled tokenizer, kept by each Python worker."""
    return Transducer(path)


def count_tokens(
    docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Bytes and tokens of every text: the id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    ``tokenizer`` is the path of a tokenizer file on every executor. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(tokenizer)
        for batch in slices(batches, "text", _SLICE_BYTES):
            texts = byte_texts(batch.column(1))
            tokens = machine.counts(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(tokens), pa.array(tokens > limit)],
                [id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    id_type = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return narrow.mapInArrow(run, f"`{id_col}` {id_type}, n_bytes long, n_tokens long, over_limit boolean")
