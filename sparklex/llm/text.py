"""Vectorised text primitives that work on Arrow string buffers.

Words are maximal runs of ASCII letters, digits or bytes >= 0x80 of the
lower-cased UTF-8 text; everything else separates.  All routines walk whole
texts: a batch is cut into chunks of whole documents only to keep the numpy
temporaries small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20

_rng = np.random.default_rng(0x5EED)
_BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

IS_WORD = np.zeros(256, bool)
IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """Avalanche of each 64-bit value (the splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    p = np.full(n, _STEP, np.uint64)
    p[:1] = 1
    return np.multiply.accumulate(p)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if n and texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES, rows: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes; a longer document is a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1
        hi = min(max(hi, lo + 1), lo + rows, n)
        yield lo, hi
        lo = hi


def word_hashes(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yields (first row, hashes of all words, word offsets per row) chunk by chunk."""
    texts = pc.utf8_lower(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts)
    data, offsets = buffers(texts)
    for lo, hi in chunks(offsets):
        own = data[offsets[lo] : offsets[hi]]
        bounds = offsets[lo : hi + 1] - offsets[lo]
        yield lo, *_words(own, bounds)


def _words(own: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = IS_WORD[own]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = bounds[:-1][bounds[:-1] < bounds[1:]]
    begins[first] = inside[first]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    at = np.flatnonzero(inside)
    head = np.searchsorted(at, starts)
    lengths = np.diff(head, append=len(at))
    pos = np.arange(len(at)) - np.repeat(head, lengths)
    value = _BYTE_CODE[own[at]] * powers(int(lengths.max()))[pos]
    return mix64(np.add.reduceat(value, head)), np.searchsorted(starts, bounds)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every window of k words; a shorter, non-empty text is one shingle."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    k_here = min(k, n)
    total = np.zeros(n - k_here + 1, np.uint64)
    for j, p in enumerate(powers(k_here + 1)[1:]):
        total += words[j : n - k_here + 1 + j] * p
    return mix64(total + np.uint64(k_here))


def binary_array(rows: np.ndarray) -> pa.Array:
    """A 2-D array's rows as an Arrow binary array, without copying row by row."""
    rows = np.ascontiguousarray(rows)
    n = len(rows)
    width = rows.nbytes // n if n else 0
    offsets = (np.arange(n + 1, dtype=np.int64) * width).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(rows)]).cast(pa.binary())
