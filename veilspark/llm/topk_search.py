"""Exact top-k inner-product search with a three-phase uniform threshold.

A vector's components are cut into LISTS column groups; a candidate's score for a query is the sum of one partial
score per group, and each group stands for a list of the candidates. A block of candidates holds its lists sorted by
the length of the candidates' parts, since no partial score exceeds the product of two lengths.

1. Every list gathers its best partial scores per query, task by task; the full scores of these few entries give each
   query a score that its k-th best surely reaches.
2. That score over the number of lists, rounded up, is the cutoff and is broadcast: a candidate below it in every list
   cannot reach the k-th best. Every list is read from the top, as far as its lengths can reach the cutoff, and the
   entries at or above it are collected. An entry's upper bound takes the cutoff less one for every other list;
   entries whose bound falls short go.
3. For the others, and only for them, the missing partial scores are resolved exactly. Each task passes on at most k
   candidates per query, best first, ties by id.

Queries go through in groups of bounded size against all candidates in blocks, so what is broadcast never grows with
the data; more queries mean more groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ._common import stage

LISTS = 4
#: Queries of one group: their vectors and cutoffs are what is broadcast (64 components: 8 MB).
GROUP_QUERIES = 1 << 14
#: Rows of a block of candidates and of queries that are multiplied together.
BLOCK_ROWS, BLOCK_QUERIES = 2048, 512
_EXACT = 1 << 53
#: The ends of a 64-bit score; beyond them a score stays at the end.
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
#: Reached by every score, and small enough to be divided and added up.
_NONE = -(1 << 62)


def _floor(x: float, scale: int) -> int:
    return int(x) * scale if abs(x) >= _EXACT else math.floor(x * scale)


class Vectors:
    """floor(scale * x) per component, shorter vectors padded by zeros, and which rows take part (``ok``): not null,
    without null or non-finite components. Rows with components so large that products might leave 64 bits stand
    apart, as Python integers, in ``wide``."""

    def __init__(self, vectors: list, scale: int = 1024) -> None:
        self.ok = np.array([v is not None and all(x is not None for x in v) for v in vectors], dtype=bool)
        arrays = [np.asarray(v, dtype=np.float64) if k else np.zeros(0) for v, k in zip(vectors, self.ok, strict=True)]
        width = max((len(a) for a in arrays), default=0)
        out = np.zeros((len(arrays), width))
        limit = math.isqrt((1 << 61) // max(width, 1))
        self.wide: dict[int, list[int]] = {}
        for i, a in enumerate(arrays):
            self.ok[i] &= bool(np.isfinite(a).all())
            if not self.ok[i]:
                continue
            if np.abs(a).max(initial=0) >= limit / scale:
                self.wide[i] = [_floor(x, scale) for x in a.tolist()]
            else:
                out[i, : len(a)] = a
        self.rows = np.floor(out * scale).astype(np.int64)

    def take(self, at: np.ndarray) -> Vectors:
        out = object.__new__(Vectors)
        out.ok, out.rows = self.ok[at], self.rows[at]
        out.wide = {k: self.wide[i] for k, i in enumerate(at.tolist()) if i in self.wide}
        return out

    def wholly(self, i: int) -> list[int]:
        return self.wide[i] if i in self.wide else self.rows[i].tolist()


def _fit(x: np.ndarray, width: int) -> np.ndarray:
    return x[:, :width] if x.shape[1] >= width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


class Block:
    """Queries against a block of candidates: their partial scores, list by list."""

    def __init__(self, queries: np.ndarray, rows: np.ndarray, lists: int) -> None:
        width = min(queries.shape[1], rows.shape[1])
        self.a, self.b = _fit(queries, width), _fit(rows, width)
        # Floating point where it is exact (and much faster).
        top = int(np.abs(self.a).max(initial=0)) * int(np.abs(self.b).max(initial=0)) * max(width, 1)
        self.kind = np.float64 if top < _EXACT else np.int64
        cut = [width * k // lists for k in range(lists + 1)]
        self.parts = [(self.a[:, s:e].astype(self.kind), self.b[:, s:e].astype(self.kind)) for s, e in zip(cut[:-1], cut[1:], strict=True)]

    def partial(self, j: int) -> np.ndarray:
        a, b = self.parts[j]
        return (a @ b.T).astype(np.int64)

    def read(self, j: int, cutoff: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List ``j`` from the top as far as some query's cutoff can be reached: the candidates read, and their
        partial scores. (A part in a thousand above the lengths' product covers their rounding.)"""
        a, b = self.parts[j]
        length = np.sqrt((b.astype(np.float64) ** 2).sum(axis=1))
        order = np.argsort(-length, kind="stable")
        of_query = np.sqrt((a.astype(np.float64) ** 2).sum(axis=1)) * 1.001
        with np.errstate(divide="ignore", invalid="ignore"):
            need = np.where(cutoff <= 0, 0.0, cutoff / of_query).min(initial=np.inf)
        seen = order[: int(np.searchsorted(-length[order], -need, side="right"))]
        return seen, (a @ b[seen].T).astype(np.int64)

    def full(self, q: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.einsum("ij,ij->i", self.a[q], self.b[c])

    def missing(self, j: int, q: np.ndarray, c: np.ndarray) -> np.ndarray:
        a, b = self.parts[j]
        return np.einsum("ij,ij->i", a[q], b[c]).astype(np.int64)


def heads(block: Block, k: int, lists: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phase 1: the entries at the head of some list (one more than ``k``, as a query may meet itself), and their full
    scores."""
    n = len(block.b)
    chosen, m = np.zeros((len(block.a), n), dtype=bool), min(k + 1, n)
    for j in range(lists):
        top = np.argpartition(-block.partial(j), m - 1, axis=1)[:, :m]
        np.put_along_axis(chosen, top, True, axis=1)
    q, c = np.nonzero(chosen)
    return q, c, block.full(q, c)


def collect(block: Block, reached: np.ndarray, lists: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phases 2 and 3: the entries that may reach the ``reached`` scores, and their full scores."""
    cutoff = -(-reached // lists)
    bound = np.repeat(lists * (cutoff - 1)[:, None], len(block.b), axis=1)
    known = np.zeros((lists, *bound.shape), dtype=bool)
    found = np.zeros(bound.shape, dtype=bool)
    for j in range(lists):
        seen, partial = block.read(j, cutoff)
        over = partial >= cutoff[:, None]
        known[j][:, seen] = over
        bound[:, seen] += np.where(over, partial - (cutoff - 1)[:, None], 0)
    np.logical_or.reduce(known, axis=0, out=found)
    q, c = np.nonzero(found & (bound >= reached[:, None]))
    score = bound[q, c]
    for j in range(lists):
        at = np.flatnonzero(~known[j, q, c])
        score[at] += block.missing(j, q[at], c[at]) - (cutoff - 1)[q[at]]
    return q, c, score


class _Best:
    """The k best (score, id) of each query that one task has seen, ties to the smaller id."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.query, self.score, self.id, self.pending, self.n = k, [], [], [], 0, n

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        self.query.append(query)
        self.score.append(score)
        self.id.append(ids)
        self.pending += len(query)
        if self.pending > max(1 << 18, 4 * self.k * self.n):
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, s, i = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (self.query, self.score, self.id))
        order = np.lexsort((i, ~s, q))  # ~s falls as s rises, at both ends of 64 bits
        q, s, i = q[order], s[order], i[order]
        keep = np.arange(len(q)) - np.searchsorted(q, q) < self.k
        q, s, i = q[keep], s[keep], i[keep]
        self.query, self.score, self.id, self.pending = [q], [s], [i], 0
        return q, s, i


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, Vectors]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(at, BLOCK_ROWS)
            vectors = Vectors(part.column(1).to_pylist())
            ids = np.asarray(part.column(0).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
            here = np.flatnonzero(vectors.ok & np.asarray(part.column(0).is_valid().to_numpy(zero_copy_only=False), dtype=bool))
            if len(here):
                yield ids[here], vectors.take(here)


def _wide_scores(queries: Vectors, rows: Vectors) -> Iterator[tuple[int, int, int]]:
    """Every pair of which either side is wide, scored in Python integers."""
    for q in range(len(queries.rows)):
        for c in range(len(rows.rows)) if q in queries.wide else rows.wide:
            score = sum(x * y for x, y in zip(queries.wholly(q), rows.wholly(c)))
            yield q, c, min(max(score, _LEAST), _MOST)


def _gather(sent, k: int, lists: int, phase: int, scored=None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries, reached = sent.value
        best = _Best(len(query_ids), k if phase > 1 else k * lists)
        for ids, rows in _blocks(batches):
            row_wide = np.isin(np.arange(len(ids)), list(rows.wide))
            for at in range(0, len(query_ids), BLOCK_QUERIES):
                own = np.arange(at, min(at + BLOCK_QUERIES, len(query_ids)))
                some = queries.take(own)
                block = Block(some.rows, rows.rows, lists)
                q, c, full = heads(block, k, lists) if phase == 1 else collect(block, reached[own], lists)
                if scored is not None:
                    scored[0].add(len(own) * len(ids))
                    scored[1].add(len(q))
                if rows.wide or some.wide:
                    plain = ~row_wide[c] & ~np.isin(q, list(some.wide))
                    wide = np.array([*_wide_scores(some, rows)], dtype=np.int64).reshape(-1, 3)
                    q, c, full = (np.concatenate(x) for x in ((q[plain], wide[:, 0]), (c[plain], wide[:, 1]), (full[plain], wide[:, 2])))
                keep = query_ids[own[q]] != ids[c]
                best.add(own[q[keep]], full[keep], ids[c[keep]])
        q, s, i = best.cut()
        if len(q):
            yield pa.RecordBatch.from_arrays([pa.array(query_ids[q]), pa.array(i), pa.array(s)], names=["query_id", "vec_id", "score"])

    return run


def top_k(df: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", lists: int = LISTS, group: int = GROUP_QUERIES, scored=None) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` highest scores of each query row, all if there are fewer.

    Queries: distinct ids of the rows for which the Column ``is_query`` holds. Candidates: every row but those with
    the query's own id. Rows with a null id, a null vector, or null or non-finite components take no part. Ids are
    meant to be unique: of several query rows with one id the first by content is the query, and repeated candidates
    rank one after another. Missing components of shorter vectors count as 0. Scores are exact; one that does not fit
    a long stands at the long's end. An empty table gives no rows; extra columns are ignored. ``scored``, two
    accumulators, is told how many pairs phase 2 met and how many it resolved.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    asked = df.where(is_query).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).where("id is not null and vector is not null")
    first = stage(asked.groupBy("id").agg(F.min("vector").alias("vector")), "queries")
    n = first.count()
    groups = max(1, -(-n // group))
    found = None
    for g in range(groups):  # each broadcast holds one group of bounded size
        part = first.where(F.pmod(F.xxhash64("id"), F.lit(groups)) == g).toPandas()
        vectors, ids = Vectors(part["vector"].tolist()), part["id"].to_numpy(dtype=np.int64)
        here = np.flatnonzero(vectors.ok)
        here = here[np.argsort(ids[here], kind="stable")]
        one = _three_phases(spark, rows, ids[here], vectors.take(here), k, lists, scored)
        found = one if found is None else found.unionByName(one)
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _three_phases(spark, rows: DataFrame, query_ids: np.ndarray, vectors: Vectors, k: int, lists: int, scored) -> DataFrame:
    schema = "query_id long, vec_id long, score long"
    sent = spark.sparkContext.broadcast((query_ids, vectors, None))
    gathered = rows.mapInArrow(_gather(sent, k, lists, 1), schema)
    # One row per query and task at most k * lists times; one number per query of this group goes to the driver.
    kth = gathered.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))).where(F.col("r") == k)
    reached = {r["query_id"]: max(r["score"], _NONE) for r in kth.select("query_id", "score").collect()}
    sent.destroy()
    low = np.array([min(reached.get(q, _NONE), -_NONE) for q in query_ids.tolist()], dtype=np.int64)
    cutoff = spark.sparkContext.broadcast((query_ids, vectors, low))
    return rows.mapInArrow(_gather(cutoff, k, lists, 2, scored), schema)
