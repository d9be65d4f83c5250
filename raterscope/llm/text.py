"""Words and bytes of texts, and small helpers of the Arrow-batch operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

_LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_TABLE = bytes.maketrans(_LOWER[0] + _SEPARATORS, _LOWER[1] + b" " * len(_SEPARATORS))


def alphanumeric_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z, as UTF-8.

    All separators are ASCII, so the bytes can be cut without decoding them.
    """
    return text.translate(_TABLE).split()


def spaced_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, as UTF-8."""
    return text.lower().split()


def byte_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null becomes empty."""
    return [b"" if value is None else value for value in column.cast(pa.large_binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the texts of each piece hold about ``limit`` bytes, one row at least."""
    for batch in batches:
        sizes = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
        lengths = [0 if size is None else size for size in pc.binary_length(sizes).to_pylist()]
        start, held = 0, 0
        for row, length in enumerate(lengths):
            if held and held + length > limit:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += length
        if start < batch.num_rows:
            yield batch.slice(start)
    pa.default_memory_pool().release_unused()
