"""Questions from chunks of documents to hash-partitioned answerers, and back.

A chunk is a row that holds some megabytes of whole documents, staged once, so that every later pass sees the same
chunks. A pass sends, per answerer, one packed array of the chunk's *distinct* keys (so a key in a third of all rows
costs one entry per chunk, not per row); the answerer replies with an array in the same order. Memory is bounded by
the chunk on one side and by the number of answerers, which follows the number of keys, on the other.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import BROADCAST_BYTES, bounded_batches, forget, shuffle_partitions, stage, tidy
from ._words import slices, word_spans

CHUNK_SCHEMA = "chunk_id long, ids binary, known binary, offsets binary, body binary, n_words long"
#: Keys that one answerer gets, about.
KEYS_PER_PART = 1_000_000


_U = np.uint64
_ZIP, _UNZIP = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def squeeze(data: bytes | memoryview) -> bytes:
    return _ZIP.compress(data)


def unsqueeze(data: bytes) -> bytes:
    return _UNZIP.decompress(data)


class Chunk:
    """Documents of one chunk: ``ids`` (int64; 0 where not ``known``), ``buf`` and ``offsets``."""

    def __init__(self, row: dict) -> None:
        self.chunk_id = row["chunk_id"]
        self.ids = np.frombuffer(row["ids"], dtype=np.int64)
        self.known = np.frombuffer(row["known"], dtype=bool)
        self.offsets = np.frombuffer(row["offsets"], dtype=np.int64)
        self.buf = np.frombuffer(unsqueeze(row["body"]), dtype=np.uint8)

    @cached_property
    def _spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return word_spans(self.buf, self.offsets)

    starts, ends, first = (property(lambda self, k=k: self._spans[k]) for k in range(3))

    def __len__(self) -> int:
        return len(self.ids)

    def text(self, i: int) -> bytes:
        return self.buf[self.offsets[i] : self.offsets[i + 1]].tobytes()


def chunks(df: DataFrame, id_col: str, text_col: str, name: str, more: Callable | None = None, more_names: tuple[str, ...] = ()) -> DataFrame:
    """The staged chunk table of ``df``; ids are cast to long, null text is empty. ``more(buf, starts, ends, first)``
    gives further binary columns, made once from a chunk's words."""
    bounded_batches(df.sparkSession)  # a row of the chunk table has megabytes: each batch is held by the JVM and by Python
    extra = [(c, pa.binary()) for c in more_names]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows, buf, off in slices(batch, "text"):
                ids = rows.column(0)
                known = np.asarray(ids.is_valid().to_numpy(zero_copy_only=False), dtype=bool)
                values = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                spans = word_spans(buf, off)
                made = zip(more_names, more(buf, *spans) if more else (), strict=True)
                yield pa.RecordBatch.from_pydict(
                    {"chunk_id": [(part << 32) | k], "ids": [values.tobytes()], "known": [known.tobytes()], "offsets": [off.tobytes()], "body": [squeeze(buf.tobytes())], "n_words": [len(spans[0])]}
                    | {c: [v] for c, v in made},
                    schema=pa.schema([*_CHUNK_ARROW, *extra]),
                )
                k += 1

    return stage(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(tidy(cut), ", ".join((CHUNK_SCHEMA, *(f"{c} binary" for c in more_names)))), name)


_CHUNK_ARROW = pa.schema([("chunk_id", pa.int64()), ("ids", pa.binary()), ("known", pa.binary()), ("offsets", pa.binary()), ("body", pa.binary()), ("n_words", pa.int64())])
_SENT = pa.schema([("p", pa.int32()), ("chunk_id", pa.int64()), ("payload", pa.binary())])
_REPLY = pa.schema([("chunk_id", pa.int64()), ("p", pa.int32()), ("reply", pa.binary())])


def parts_for(spark, keys: int) -> int:
    """How many answerers: as many as shuffle partitions, more if the keys need it."""
    return max(shuffle_partitions(spark), math.ceil(keys / KEYS_PER_PART))


def stable_order(keys: np.ndarray) -> np.ndarray:
    """``np.argsort(keys, kind="stable")`` of 64-bit hashes by a plain sort: the leading bits of each with its position
    below them. Different keys with the same leading bits may come out of order; then the keys are sorted whole."""
    low = _U((1 << max(1, (len(keys) - 1).bit_length())) - 1)
    packed = (keys & ~low) | np.arange(len(keys), dtype=_U)
    packed.sort()
    order = (packed & low).astype(np.int64)
    got = keys[order]
    return np.argsort(keys, kind="stable") if (got[1:] < got[:-1]).any() else order


def bounds(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where sorted 64-bit keys are cut for ``parts`` answerers of equal key ranges: parts + 1 positions."""
    step = (1 << 64) // parts
    cuts = np.array([step * k for k in range(1, parts)], dtype=np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, cuts), [len(keys)])).astype(np.int64)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as their steps, in as many bytes each as is shortest; longer steps stand whole beside."""
    steps = np.diff(keys, prepend=keys[:1] * 0)
    bits = np.ceil(np.log2(steps.astype(np.float64) + 1))
    width = min(range(1, 9), key=lambda w: len(keys) * w + 12 * int((bits > 8 * w - 1).sum()))
    far = np.flatnonzero(bits > 8 * width - 1) if width < 8 else np.zeros(0, dtype=np.int64)
    near = np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])
    return b"".join((np.array([len(keys), len(far), width], dtype="<u4").tobytes(), far.astype("<u4").tobytes(), steps[far].astype("<u8").tobytes(), near.tobytes()))


def unpack_keys(data: bytes | memoryview) -> np.ndarray:
    n, m, width = np.frombuffer(data, "<u4", 3).tolist()
    near = np.zeros((n, 8), dtype=np.uint8)
    near[:, :width] = np.frombuffer(data, np.uint8, n * width, 12 + 12 * m).reshape(n, width)
    steps = near.view("<u8").ravel()
    steps[np.frombuffer(data, "<u4", m, 12)] = np.frombuffer(data, "<u8", m, 12 + 4 * m)
    return np.cumsum(steps, dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts in the shortest of four widths, compressed."""
    size = next(s for s in (1, 2, 4, 8) if int(counts.max(initial=0)) < 1 << (8 * s))
    return bytes([size]) + squeeze(counts.astype(f"<u{size}").tobytes())


def unpack_counts(data: bytes | memoryview) -> np.ndarray:
    return np.frombuffer(unsqueeze(data[1:]), f"<u{data[0]}").astype(np.int64)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}


def ask(
    table: DataFrame,
    questions: Callable[[dict], Iterator[tuple[int, bytes]]],
    answer: Callable[[list[bytes]], list[bytes]],
    reply_name: str,
) -> DataFrame:
    """Runs a pass: ``questions(row)`` gives (answerer, payload) pairs, ``answer(payloads)`` a reply for each, and the
    result has a row ``chunk_id, <reply_name>`` (replies in answerer order) for each chunk that asked anything."""

    def send(batches):
        for row in rows_of(batches):
            p, payload = [], []
            for k, data in questions(row):
                p.append(k)
                payload.append(data)
            if p:
                yield pa.RecordBatch.from_pydict({"p": p, "chunk_id": [row["chunk_id"]] * len(p), "payload": payload}, schema=_SENT)

    def reply(t: pa.Table) -> pa.Table:
        got = t.column("payload").to_pylist()
        try:
            return pa.Table.from_pydict({"chunk_id": t.column("chunk_id"), "p": t.column("p"), "reply": answer(got)}, schema=_REPLY)
        finally:
            forget()

    sent = table.mapInArrow(tidy(send), "p int, chunk_id long, payload binary")
    back = sent.groupBy("p").applyInArrow(reply, "chunk_id long, p int, reply binary")
    # As many replies for a chunk as answerers, together as long as the chunk's distinct keys.
    gathered = back.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("p", "reply"))).alias("_r"))
    return stage(gathered.select("chunk_id", F.transform("_r", lambda x: x["reply"]).alias(reply_name)), "replies")


def with_replies(table: DataFrame, replies: DataFrame, name: str, grows: bool = False) -> DataFrame:
    """The chunk table with a pass's replies: broadcast if their measured bytes allow, else joined by shuffle; always
    by shuffle if they ``grow`` as the texts do."""
    if grows:
        return table.join(replies, "chunk_id", "left")
    size = replies.select(F.sum(F.expr(f"aggregate({name}, 0L, (a, x) -> a + octet_length(x))"))).first()[0] or 0
    return table.join(F.broadcast(replies) if size <= BROADCAST_BYTES else replies, "chunk_id", "left")


def bits(replies: list[bytes] | None, counts: np.ndarray) -> np.ndarray:
    """Unpacks bit replies of ``counts[k]`` bits each; answerers that were asked nothing sent none."""
    asked = [int(c) for c in counts if c]
    if not asked:
        return np.zeros(0, dtype=bool)
    return np.concatenate([np.unpackbits(np.frombuffer(r, dtype=np.uint8), count=c) for r, c in zip(replies, asked, strict=True)]).astype(bool)
