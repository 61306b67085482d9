"""Best-fit-decreasing packing of indivisible groups into shards.

Groups are rows with equal text. Their exact sizes, as counted classes, go to the driver. D different sizes add up to at
least D * (D + 1) / 2 bytes, so there are at most sqrt(2 * bytes) classes: 14 million for 100 TB. The driver packs a whole
class at a time: the tightest bin that takes one group of a size stays the tightest until it cannot take another, so a
run of equal sizes needs one step per bin it touches and the result is that of packing group by group. Groups find
their bin by their rank in their class.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import ranked, small_or_shuffled, stage


class CapacityTree:
    """Balanced (randomised, heap-ordered) search tree of bins by remaining capacity; ties go to the older bin."""

    __slots__ = ("_rnd", "_root")

    def __init__(self, seed: int = 1) -> None:
        self._root, self._rnd = None, random.Random(seed)

    def add(self, room: int, shard: int) -> None:
        low, high = self._split(self._root, (room, shard))
        self._root = self._merge(self._merge(low, [(room, shard), self._rnd.random(), None, None]), high)

    def take_tightest(self, need: int) -> tuple[int, int] | None:
        """Removes and returns the bin with the least room of at least ``need``."""
        low, high = self._split(self._root, (need, -1))
        if high is None:
            self._root = low
            return None
        path, node = [], high
        while node[2] is not None:
            path.append(node)
            node = node[2]
        if path:
            path[-1][2] = node[3]
        else:
            high = node[3]
        self._root = self._merge(low, high)
        return node[0]

    def _split(self, node, key):
        if node is None:
            return None, None
        if node[0] < key:
            node[3], high = self._split(node[3], key)
            return node, high
        low, node[2] = self._split(node[2], key)
        return low, node

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b


def best_fit_decreasing(classes: Iterable[tuple[int, int]], capacity: int, most: int | None = None, first: int = 0) -> list[tuple[int, int]] | None:
    """Segments (groups, bin) in the order of ``classes`` = (size, groups), sizes falling.

    A group larger than ``capacity`` gets a bin of its own. None if more than ``most`` bins would open. Bins are
    numbered from ``first``.
    """
    tree, opened, out = CapacityTree(), 0, []
    for size, n in classes:
        while n:
            found = tree.take_tightest(size)
            if found is None:
                if most is not None and opened == most:
                    return None
                found = (max(capacity, size), first + opened)
                opened += 1
            room, shard = found
            k = min(n, room // size)
            n -= k
            if room - k * size > 0:
                tree.add(room - k * size, shard)
            if out and out[-1][1] == shard:
                out[-1] = (out[-1][0] + k, shard)
            else:
                out.append((k, shard))
    return out


def fit_into(classes: list[tuple[int, int]], shards: int) -> list[tuple[int, int]]:
    """Packs into ``shards`` bins so that they come out near even. Segments as those of ``best_fit_decreasing``.

    The capacity is bisected down to the least at which everything fits. A group above an even share of what is left
    takes a bin alone. Where large groups ask for a capacity above the even share, the first bin stands as it is and
    what is left is packed anew into the other bins, at a capacity of their own.
    """
    placed: list[tuple[int, int, int]] = []  # size, groups, bin
    rest, at, fits = [*classes], 0, None
    while rest:
        bins, left = shards - at, sum(s * n for s, n in rest)
        share = -(-left // bins)
        if bins > 1 and rest[0][0] * bins > left:
            first, fits = [(rest[0][0], 1)], None
        else:
            fits = _least_capacity(rest, bins, share, fits)
            spread = _spread(rest, fits[1])
            if bins == 1 or fits[0] - share <= share // 1000:
                placed += [(s, n, at + b) for s, n, b in spread]
                break
            first = [(s, n) for s, n, b in spread if b == 0]
            # The others' packing stands as a first fit of what is left.
            fits = fits[0], [(n, b - 1) for _, n, b in spread if b]
        placed += [(s, n, at) for s, n in first]
        taken = Counter()
        for s, n in first:
            taken[s] += n
        rest, at = [(s, n - taken[s]) for s, n in rest if n > taken[s]], at + 1
    return [(n, b) for _, n, b in sorted(placed, key=lambda p: -p[0])]


def _least_capacity(classes: list[tuple[int, int]], bins: int, share: int, fits: tuple | None) -> tuple[int, list[tuple[int, int]]]:
    """The least capacity from ``share`` on, by bisection, and its packing; ``fits`` is one that is known to do."""
    fails, step = share - 1, 0
    while fits is None:
        packed = best_fit_decreasing(classes, share + step, bins)
        if packed is None:
            fails, step = share + step, max(1, step * 4)
        else:
            fits = share + step, packed
    while fits[0] - fails > 1:
        mid = (fits[0] + fails) // 2
        packed = best_fit_decreasing(classes, mid, bins)
        if packed is None:
            fails = mid
        else:
            fits = mid, packed
    return fits


def _spread(classes: list[tuple[int, int]], segments: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Segments over ``classes``, cut where the size changes: size, groups, bin."""
    out, k, used = [], 0, 0
    for n, shard in segments:
        while n:
            size, of = classes[k]
            take = min(n, of - used)
            out.append((size, take, shard))
            n, used = n - take, used + take
            if used == of:
                k, used = k + 1, 0
    return out


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int | None = 8, capacity: int | None = None) -> DataFrame:
    """One row per input row: ``<id_col>, size, text_crc32, shard, slot``.

    ``size`` is the text's UTF-8 bytes plus 1. Give ``capacity`` to get as few shards of that many bytes as
    best-fit-decreasing opens, or ``shards`` to get that many of the least capacity. Null texts form one group, apart
    from empty ones, of size 1 each. ``slot`` counts a shard's rows from 0, by id (null first), then content; equal
    rows are interchangeable. Groups of one size go by hash of their text. Texts of any length count whole and exactly.
    An empty table gives no rows; extra columns are ignored.
    """
    size = (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long")
    base = stage(
        df.select(
            F.col(id_col).alias("id"),
            size.alias("size"),
            F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
            F.when(F.col(text_col).isNull(), F.lit(b"")).otherwise(F.unhex(F.sha2(F.col(text_col), 256))).alias("key"),
        ),
        "pack",
    )
    groups = base.groupBy("key").agg(F.sum("size").alias("bytes"))
    order, _ = ranked(groups, [F.col("bytes").desc(), F.col("key")], "pack-groups")
    found = order.groupBy("bytes").agg(F.count("*").alias("n"), F.min("rank").alias("start")).toPandas().sort_values("bytes", ascending=False)
    classes = list(zip(found["bytes"].tolist(), found["n"].tolist(), strict=True))
    segments = best_fit_decreasing(classes, capacity) if capacity else fit_into(classes, shards)
    bins: list[list[tuple[int, int]]] = [[] for _ in classes]  # of each class, up to which rank it goes into which bin
    k, start = -1, 0
    for size, n, shard in _spread(classes, segments):
        if k < 0 or classes[k][0] != size:
            k, start = k + 1, int(found["start"].iloc[k + 1])
        start += n
        bins[k].append((start, shard))
    held = pd.DataFrame({"bytes": found["bytes"], "_ends": [[e for e, _ in x] for x in bins], "_bins": [[b for _, b in x] for x in bins]})
    held = df.sparkSession.createDataFrame(held, "bytes long, _ends array<long>, _bins array<int>")
    shard = F.expr("element_at(_bins, cast(size(filter(_ends, e -> e <= rank)) + 1 as int))")
    placed = order.join(small_or_shuffled(held, 64, len(classes) + len(segments)), "bytes").select("key", shard.alias("shard"))
    placed = base.join(placed, "key").drop("key")
    rows, _ = ranked(placed, [F.col("shard"), F.col("id"), F.col("text_crc32"), F.col("size")], "pack-rows")
    if capacity:  # there may be many shards: their starts are joined, broadcast only when measured small
        starts = rows.groupBy("shard").agg(F.min("rank").alias("_start"))
        return rows.join(small_or_shuffled(starts, 16), "shard").select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("rank") - F.col("_start")).alias("slot"))
    start, at = F.lit(0), 0
    for shard, n in sorted((r["shard"], r["n"]) for r in rows.groupBy("shard").agg(F.count("*").alias("n")).collect()):  # a row per shard asked for
        start, at = F.when(F.col("shard") == shard, F.lit(at)).otherwise(start), at + n
    return rows.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("rank") - start).cast("long").alias("slot"))
