"""Sets of hashed word shingles, for many texts at a time."""

from __future__ import annotations

import re

import numpy as np
import xxhash

# An odd multiplier; its powers by the place of a byte in its word.
_LONG_WORD = 64
_P = 0x9E3779B97F4A7C15
_POWERS = np.array([pow(_P, i, 1 << 64) for i in range(_LONG_WORD)], np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SEPARATOR = re.compile(rb"[\x20\x09-\x0D]")
# Bytes looked at together: what a very long text takes does not grow with it.
_PIECE = 1 << 18


def mix(values: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values (the finaliser of SplitMix64)."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _piece_hashes(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word of a byte stream that neither begins nor ends within a word.

    A sum over the bytes for words up to 64 bytes; longer words are hashed one by one.
    """
    inside = ~_SPACE[stream]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    starts, ends = edges[0::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    lengths = ends - starts
    place = np.flatnonzero(inside)
    in_word = place - np.repeat(starts, lengths)
    values = (stream[place].astype(np.uint64) + np.uint64(1)) * _POWERS[np.minimum(in_word, _LONG_WORD - 1)]
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    hashes = np.add.reduceat(values, first) + lengths.astype(np.uint64)
    for i in np.flatnonzero(lengths > _LONG_WORD).tolist():
        hashes[i] = xxhash.xxh64_intdigest(stream[starts[i] : ends[i]].tobytes())
    return mix(hashes), starts


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased) and the number of words of each text."""
    data = b"".join(t + b"\n" for t in texts).lower()
    hashes, starts, begin = [], [], 0
    while begin < len(data):
        cut = _SEPARATOR.search(data, begin + _PIECE)
        end = cut.end() if cut else len(data)
        found, places = _piece_hashes(np.frombuffer(data, np.uint8, end - begin, begin))
        hashes.append(found)
        starts.append(places + begin)
        begin = end
    closes = np.cumsum([len(t) + 1 for t in texts])
    all_starts = np.concatenate([np.zeros(0, np.int64), *starts])
    counts = np.diff(np.concatenate([[0], np.searchsorted(all_starts, closes)]))
    return np.concatenate([np.zeros(0, np.uint64), *hashes]), counts


def shingle_sets(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of every text, sorted, one text after the other; and where each text begins.

    A text of fewer words has its whole sequence as one shingle, a text without words none. The offsets
    have one entry more than there are texts.
    """
    words, counts = word_hashes(texts)
    begins = np.concatenate([[0], np.cumsum(counts)])
    combined = np.zeros(len(words), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            factor = np.uint64(pow(0xD1342543DE82EF95, i + 1, 1 << 64))
            combined[: len(words) - i] += words[i:] * factor
    combined = mix(combined)
    sets = []
    for begin, end in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
        if end - begin >= width:
            own = np.sort(combined[begin : end - width + 1])
            sets.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif end > begin:
            whole = xxhash.xxh64_intdigest(words[begin:end].tobytes(), seed=end - begin)
            sets.append(np.array([whole], np.uint64))
        else:
            sets.append(np.zeros(0, np.uint64))
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
    return np.concatenate([np.zeros(0, np.uint64), *sets]), offsets
