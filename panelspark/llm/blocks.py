"""Texts of an Arrow batch as flat byte arrays, so that numpy works on all documents of a block at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 2 << 20
M64 = (1 << 64) - 1
#: ASCII space and \x09-\x0D, the separators of words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with about `most` bytes of text (one document at least), the bytes, and each document's start in them."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        at = 0
        while at < len(column):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


def spans(data: np.ndarray, starts: np.ndarray, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each maximal run of bytes outside `apart`, never across documents, and each document's first run."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(starts), np.int64)
    word = ~apart[data]
    before = np.empty_like(word)
    before[0], before[1:] = False, word[:-1]
    first = starts[:-1][starts[:-1] < len(data)]
    before[first] = False
    begin = np.flatnonzero(word & ~before)
    after = np.empty_like(word)
    after[-1], after[:-1] = False, word[1:]
    after[first[first > 0] - 1] = False
    end = np.flatnonzero(word & ~after) + 1
    return begin, end, np.searchsorted(begin, starts)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes (public splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse
    if len(_powers) < n:
        n = max(n, BLOCK_BYTES + 1)
        _powers, _inverse = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
        _powers[0] = _inverse[0] = 1
        _powers, _inverse = np.cumprod(_powers, dtype=np.uint64), np.cumprod(_inverse, dtype=np.uint64)
    return _powers, _inverse


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, by polynomial prefix sums: equal bytes, equal hash, wherever they stand."""
    powers, inverse = _tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers[: len(data)], out=sums[1:])
    return mixed((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def document_of(first: np.ndarray) -> np.ndarray:
    """For each run, its document's index; `first` as from spans()."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
