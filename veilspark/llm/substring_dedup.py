"""Substring deduplication by level-wise doubling of repeated windows.

The levels are windows of 1, 2, 4, 8 ... words and at last of the wanted length; a window's hash is made of those of the
two windows of the level before that cover it. At every level each chunk asks which of its windows stand in another
document too, but only for windows inside a wanted window all of whose parts have repeated so far: a word that no
other document has takes every window around it out at the first level. At the wanted length each window learns whether
a smaller document has it. With ``extend`` the doubling goes on from there until no candidate survives, and each
document reports the longest level that repeats.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import tidy
from ._exchange import Chunk, ask, bits, bounds, chunks, pack_keys, parts_for, rows_of, squeeze, stable_order, unpack_keys, unsqueeze, with_replies
from ._words import doc_of_word, double, inside, mix64, word_hashes

_U = np.uint64
#: Leading bits of a hash by which windows shorter than the wanted ones are compared: equal bits of different windows
#: only keep more candidates.
_SHORT = _U(16)


def levels(length: int, extend: bool) -> Iterator[int]:
    """Window lengths: 1, doubled up to ``length``, and on while asked for."""
    size = 1
    while size < length:
        yield size
        size *= 2
    while True:
        yield length
        if not extend:
            return
        length *= 2


#: Columns of the chunk table beside the texts: the hashes of a chunk's distinct words, which of them each word is, and
#: where documents begin. Passes read these; only the last one reads the texts.
_WORDS = ("vocabulary", "codes", "firsts")


def _coded(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[bytes, bytes, bytes]:
    hashes = word_hashes(buf, starts, ends, 0)
    order = stable_order(hashes)
    new = _new(hashes[order])
    codes = np.empty(len(hashes), dtype="<u4")
    codes[order] = np.cumsum(new) - 1
    planes = np.ascontiguousarray(codes.view(np.uint8).reshape(-1, 4).T)
    return pack_keys(hashes[order][new]), squeeze(planes.tobytes()), first.astype("<i8").tobytes()


def _decoded(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """The words' hashes and where documents begin, of a chunk."""
    planes = np.frombuffer(unsqueeze(row["codes"]), dtype=np.uint8).reshape(4, -1)
    codes = np.ascontiguousarray(planes.T).view("<u4").ravel()
    return unpack_keys(row["vocabulary"])[codes], np.frombuffer(row["firsts"], dtype="<i8")


def _new(sorted_keys: np.ndarray) -> np.ndarray:
    """Where a new key begins."""
    new = np.ones(len(sorted_keys), dtype=bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    return new


def _windows(lead: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of windows by both parts of their hash, and in that order where a new window begins."""
    order = stable_order(lead)
    new, r = _new(lead[order]), rest[order]
    if (~new[1:] & (r[1:] != r[:-1])).any():  # one lead, different rests
        order = np.lexsort((rest, lead))
        new = _new(lead[order]) | _new(rest[order])
    return order, new


class _Walk:
    """One chunk's way through the ``answered`` levels; unless ``final``, then what it asks at the next one."""

    def __init__(self, row: dict, length: int, answered: int, extend: bool, final: bool = False) -> None:
        self.parts, self.payload, self.shift = row["parts"], None, _SHORT
        doc_ids, known = np.frombuffer(row["ids"], dtype=np.int64), np.frombuffer(row["known"], dtype=bool)
        ga, first = _decoded(row)
        doc = doc_of_word(first)
        # More bits of hash, only for windows that decide.
        gb = mix64(ga + _U(1)) if 1 << answered >= length else None
        n = max(0, len(ga) - length + 1)
        ok = inside(first, length)[:n] & known[doc[:n]]
        self.removed, self.longest = np.zeros(n, dtype=bool), np.zeros(len(doc_ids), dtype=np.int64)
        prev = 1
        for k, size in enumerate(levels(length, extend)):
            if final and k == answered:
                return
            if size > length:  # candidates are the windows both of whose halves repeat
                m = max(0, len(ok) - prev)
                ok = repeated[:m] & repeated[prev : prev + m] & (doc[:m] == doc[prev : prev + m])  # noqa: F821
            if size > prev:
                ga, gb = double(ga, prev, size, 0), None if gb is None else double(gb, prev, size, 1)
            prev = size
            if size < length:
                ok = self._part(row, k, answered, ok, ga, doc, length - size)
                if k == answered:
                    return
                continue
            self.shift = _U(0)
            at = np.flatnonzero(ok)
            ids = doc_ids[doc[at]]
            lead, rest = ga[at], (gb[at] & _U(0xFFFFFFFF)).astype(np.uint32)
            order, new = _windows(lead, rest)
            starts, group = np.flatnonzero(new), np.cumsum(new) - 1
            self.keys, least = lead[order][new], np.minimum.reduceat(ids[order], starts) if len(at) else ids
            if k == answered:
                self.payload = (rest[order][new], least, np.maximum.reduceat(ids[order], starts) if len(at) else ids)
                return
            smaller, other = _two_flags(row[f"r{k}"], np.diff(bounds(self.keys, self.parts)))
            if size == length:
                self.removed[at[order]] = smaller[group] | (ids[order] > least[group])
            repeated = np.zeros(len(ok), dtype=bool)
            repeated[at[order]] = other[group]
            if extend:
                np.maximum.at(self.longest, doc[np.flatnonzero(repeated)], size)

    def _part(self, row: dict, k: int, answered: int, ok: np.ndarray, hashes: np.ndarray, doc: np.ndarray, beyond: int) -> np.ndarray:
        """A level below the wanted length: of the wanted windows ``ok`` those in which every window of this level (the
        last begins ``beyond`` words after the first) stands in another document."""
        edge = np.zeros(len(hashes) + 1, dtype=np.int32)
        starts = np.flatnonzero(ok)
        edge[starts] += 1
        edge[starts + beyond + 1] -= 1
        at = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        keys = hashes[at] >> self.shift << self.shift
        if k == answered:
            keys.sort()
            self.keys = keys[_new(keys)] >> self.shift
            return ok
        order = stable_order(keys)  # within a key, documents rise
        new = _new(keys[order])
        keys = keys[order][new]
        in_doc = doc[at[order]]
        shared = (in_doc[new] != in_doc[_ends(new)]) | bits(row[f"r{k}"], np.diff(bounds(keys, self.parts)))
        alone = np.zeros(len(hashes) + 1, dtype=np.int32)
        alone[at[order] + 1] = ~shared[np.cumsum(new) - 1]
        alone = np.cumsum(alone, dtype=np.int32)
        ok[starts] = alone[starts + beyond + 1] == alone[starts]
        return ok

    def questions(self) -> Iterator[tuple[int, bytes]]:
        cut = bounds(self.keys << self.shift, self.parts)
        for p, (s, e) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            if e > s:
                if self.payload is None:
                    yield p, pack_keys(self.keys[s:e])
                else:
                    yield p, squeeze(b"".join(x[s:e].tobytes() for x in (self.keys, *self.payload)))


def _ends(new: np.ndarray) -> np.ndarray:
    """Where groups end, from where they begin."""
    return np.append(new[1:], True) if len(new) else new


def _two_flags(replies: list[bytes] | None, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    got, cut = bits(replies, 2 * counts), np.concatenate(([0], np.cumsum(counts)))
    pairs = list(zip(cut[:-1], cut[1:], strict=True))
    none = [np.zeros(0, dtype=bool)]
    return np.concatenate(none + [got[2 * s : s + e] for s, e in pairs]), np.concatenate(none + [got[s + e : 2 * e] for s, e in pairs])


def _shared_elsewhere(payloads: list[bytes]) -> list[bytes]:
    arrays = [unpack_keys(p) for p in payloads]
    keys = np.concatenate(arrays)
    order = stable_order(keys << _SHORT)
    new = _new(keys[order])
    shared = np.empty(len(keys), dtype=bool)
    shared[order] = ~(new & _ends(new))
    return _in_turn(np.packbits, shared, arrays)


def _in_turn(pack, flags: np.ndarray, arrays: list[np.ndarray]) -> list[bytes]:
    at, out = 0, []
    for a in arrays:
        out.append(pack(flags[at : at + len(a)]).tobytes())
        at += len(a)
    return out


def _owners(payloads: list[bytes]) -> list[bytes]:
    """Two bits per window: a smaller document has it; another document has it."""
    parts = []
    for p in payloads:
        data = unsqueeze(p)
        n = len(data) // 28
        parts.append((np.frombuffer(data, _U, n), np.frombuffer(data, np.uint32, n, 8 * n), np.frombuffer(data, np.int64, n, 12 * n), np.frombuffer(data, np.int64, n, 20 * n)))
    lead, rest, least, most = (np.concatenate(x) for x in zip(*parts, strict=True))
    order, new = _windows(lead, rest)
    starts = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    lo, hi = np.minimum.reduceat(least[order], starts), np.maximum.reduceat(most[order], starts)
    smaller, other = np.empty(len(lead), dtype=bool), np.empty(len(lead), dtype=bool)
    smaller[order] = lo[group] < least[order]
    other[order] = (lo != hi)[group]
    at, out = 0, []
    for p in parts:
        e = at + len(p[0])
        out.append(np.packbits(np.concatenate((smaller[at:e], other[at:e]))).tobytes())
        at = e
    return out


_OUT = pa.schema(
    [("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("longest", pa.int64()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept_text", pa.string())]
)


def _remove(walk: _Walk, chunk: Chunk, length: int) -> pa.RecordBatch:
    delta = np.zeros(int(chunk.first[-1]) + 1, dtype=np.int32)
    at = np.flatnonzero(walk.removed)
    delta[at] += 1
    delta[at + length] -= 1
    covered = np.cumsum(delta[:-1]) > 0
    n_words, n_removed, spans, kept = [], [], [], []
    for i in range(len(chunk)):
        gone = covered[chunk.first[i] : chunk.first[i + 1]]
        words = chunk.text(i).split()
        n_words.append(len(words))
        n = int(gone.sum())
        n_removed.append(n)
        if n:
            edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
            spans.append([{"start": int(s), "end": int(e)} for s, e in zip(edge[::2], edge[1::2], strict=True)])
            words = compress(words, ~gone)
        else:
            spans.append([])
        kept.append(b" ".join(words).decode())
    ids = pa.array(chunk.ids, mask=~chunk.known)
    return pa.RecordBatch.from_arrays([ids, *(pa.array(x, type=_OUT.field(k).type) for k, x in ((1, n_words), (2, n_removed), (3, walk.longest), (4, spans), (5, kept)))], schema=_OUT)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 13, extend: bool = True) -> DataFrame:
    """One row per input row: ``<id_col>, n_words, n_removed, longest, removed, kept_text``.

    Words are runs of non-blank characters, unchanged. Every word inside a window of ``length`` words whose sequence
    also starts in a row with a smaller id is removed; windows are judged on the input. ``removed`` lists the removed
    word ranges, ``kept_text`` joins the rest by one blank, ``longest`` (with ``extend``) is the last level, ``length``
    doubled as long as it repeats in another document. Null text has no words; a row with a null id neither loses
    words nor causes a loss; rows of equal id do not affect each other. Texts of any length go whole, one of more than
    some megabytes in a chunk of its own; an empty table gives no rows. Extra columns are ignored.
    """
    spark = df.sparkSession
    table = chunks(df, id_col, text_col, "substrings", _coded, _WORDS)
    words = table.agg(F.sum("n_words")).first()[0] or 0
    table = table.withColumn("parts", F.lit(parts_for(spark, words)))
    answered = 0
    for k, size in enumerate(levels(length, extend)):
        answer = _owners if size >= length else _shared_elsewhere
        replies = ask(table.drop("body", "offsets"), lambda row, k=k: _Walk(row, length, k, extend).questions(), answer, f"r{k}")
        if replies.isEmpty():  # no candidate survives
            break
        table, answered = with_replies(table, replies, f"r{k}"), k + 1

    def finish(batches):
        for row in rows_of(batches):
            yield _remove(_Walk(row, length, answered, extend, final=True), Chunk(row), length)

    out = table.mapInArrow(tidy(finish), "id long, n_words long, n_removed long, longest long, removed array<struct<start:long,end:long>>, kept_text string")
    return out.withColumnRenamed("id", id_col)
