"""Vectorised words, word hashes and n-gram hashes over the raw UTF-8 buffers of Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text that are worked on together; a longer text is taken alone.
SLICE_BYTES = 4 << 20
SLICE_ROWS = 1 << 16
#: Bytes hashed together; the tables of powers, which a worker keeps, are as long as this and _LONG.
_BLOCK = 1 << 17
#: Longer words are hashed one by one.
_LONG = 1 << 16
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_U = np.uint64

BLANK = np.zeros(256, dtype=bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


@lru_cache(maxsize=4)
def _powers(family: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    odd = _ODD[family]
    inverse = pow(odd, -1, 1 << 64)
    n = _BLOCK + _LONG + 1
    up, down = np.full(n, odd, dtype=_U), np.full(n, inverse, dtype=_U)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down), mix64(np.arange(1, 257, dtype=_U) * _U(odd))


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words (runs of non-blank bytes inside one document), and per document its first word's
    index, with the word count appended."""
    solid = ~BLANK[buf]
    edge = np.zeros(len(buf) + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(len(buf), dtype=bool)
    after = np.empty(len(buf), dtype=bool)
    if len(buf):
        before[0] = after[-1] = False
        before[1:] = solid[:-1]
        after[:-1] = solid[1:]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, family: int = 0) -> np.ndarray:
    """64-bit hashes of the words' bytes."""
    up, down, table = _powers(family)
    out = np.empty(len(starts), dtype=_U)
    i = 0
    while i < len(starts):
        if ends[i] - starts[i] > _LONG:
            out[i] = xxhash.xxh3_64_intdigest(buf[starts[i] : ends[i]].tobytes(), seed=family)
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _BLOCK, side="right")))
        long = np.flatnonzero(ends[i:j] - starts[i:j] > _LONG)
        if len(long):
            j = i + int(long[0])
        at = starts[i]
        part = table[buf[at : ends[j - 1]]] * up[: ends[j - 1] - at]
        sums = np.zeros(len(part) + 1, dtype=_U)
        np.cumsum(part, out=sums[1:])
        s, e = starts[i:j] - at, ends[i:j] - at
        out[i:j] = mix64((sums[e] - sums[s]) * down[s] + (e - s).astype(_U))
        i = j
    return out


def double(left: np.ndarray, length: int, target: int, family: int = 0) -> np.ndarray:
    """Hashes of ``target``-word windows from those of ``length``-word windows, length < target <= 2 * length: each is
    the pair of the windows that cover it."""
    n = len(left) - (target - length)
    if n <= 0:
        return left[:0]
    return mix64(left[:n] * _U(_ODD[family]) + left[target - length :] + _U(target))


def gram_hashes(words: np.ndarray, n: int, family: int = 0) -> np.ndarray:
    """Hashes of all runs of ``n`` words, document bounds left aside."""
    odd = _U(_ODD[family])
    m = max(0, len(words) - n + 1)
    h = words[:m].copy()
    for k in range(1, n):
        h = h * odd + words[k : k + m]
    return mix64(h + _U(n))


def inside(first: np.ndarray, n: int) -> np.ndarray:
    """For each word whether a run of ``n`` words from it stays in its document; ``first`` as of word_spans."""
    total = int(first[-1])
    ok = np.ones(total, dtype=bool)
    for k in range(1, n):
        at = first[1:] - k
        at = at[at >= first[:-1]]
        ok[at] = False
    return ok


def doc_of_word(first: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets (from 0, one more than rows) of a string column; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if offsets is None or len(column) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    off = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return buf, off - off[0]


def slices(batch: pa.RecordBatch, text_col: str, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch of about ``most`` bytes of text, of at least one row each: (rows, bytes, offsets)."""
    column = batch.column(batch.schema.get_field_index(text_col))
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    buf, off = text_buffer(column)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        j = min(j, len(column), i + SLICE_ROWS)
        yield batch.slice(i, j - i), buf[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j
