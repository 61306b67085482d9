"""Exact n-gram Jaccard self-join with prefix trees.

1. Each document becomes its set of hashed word n-grams; equal sets become one *class* (copies go no further).
2. Every n-gram learns in how many chunks of documents it stands, and sets are ordered globally, rare n-grams first.
   Similar sets must share one of their first n-grams, so a class whose first n-grams stand nowhere else is settled;
   the others fall into families (connected by shared first n-grams, where sizes allow similarity).
3. Each family is joined in a prefix tree over its ordered sets. A search walks shared paths once, carries the
   partial overlap, and leaves a subtree when the n-grams already missed on either side, against the lengths below,
   rule the threshold out. A family above a bounded block is cut into blocks and every pair of blocks is a task, so
   no task holds an unbounded family; nothing is dropped and no list of pairs is made.
4. Links found join classes into components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import BROADCAST_BYTES, forget, stage, tidy
from ._components import components
from ._exchange import Chunk, ask, bounds, chunks, parts_for, rows_of, squeeze, unsqueeze, with_replies
from ._words import FOLD, doc_of_word, gram_hashes, inside, mix64, word_hashes, word_spans

_U = np.uint64
#: N-grams and sets of a family that one block holds, about, and n-grams that one joining task gets, about. Every block
#: meets every other of its family: what is shipped and hashed grows with their number, so they are not made small.
BLOCK_GRAMS = 320_000
BLOCK_SETS = 2_000
TASK_GRAMS = 200_000
#: Words of the corpus for which one task matches first n-grams: few of them stand in two classes, and a pair of
#: classes that shares many of them is found once per task.
FIRST_GRAM_WORDS = 10_000_000
#: Bytes of whole documents whose words are held at a time, each of them in several arrays; a longer document is taken alone.
GRAM_BYTES = 512 << 10


def gram_sets(buf: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each document, end to end, and where each document's begin (and the end).

    A-Z is lower-cased. A document of fewer words has its whole sequence as one n-gram; without words, none.
    """
    grams, sizes, i = [np.zeros(0, dtype=_U)], [np.zeros(1, dtype=np.int64)], 0
    while i < len(offsets) - 1:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + GRAM_BYTES, side="right")) - 1)
        hashes, at = _gram_sets(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], n)
        grams.append(hashes)
        sizes.append(np.diff(at))
        i = j
    return np.concatenate(grams), np.cumsum(np.concatenate(sizes))


def _gram_sets(buf: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = word_spans(buf, offsets)
    words = word_hashes(FOLD[buf], starts, ends)
    ok = inside(first, n)
    grams = gram_hashes(words, n)
    at = np.flatnonzero(ok[: len(grams)])
    hashes, docs = grams[at], doc_of_word(first)[at]
    counts = np.diff(first)
    short = [(i, gram_hashes(words[first[i] : first[i + 1]], int(counts[i]))[0]) for i in np.flatnonzero((counts > 0) & (counts < n))]
    if short:
        docs = np.concatenate((docs, [i for i, _ in short]))
        hashes = np.concatenate((hashes, np.array([h for _, h in short], dtype=_U)))
    order = np.lexsort((hashes, docs))
    hashes, docs = hashes[order], docs[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1])
    hashes, docs = hashes[new], docs[new]
    return hashes, np.searchsorted(docs, np.arange(len(offsets)))


def least_overlap(size: int | np.ndarray, percent: int):
    """The least overlap that a set of ``size`` needs with any set similar to it."""
    return -(-size * percent // 100)


class _Sets:
    """A chunk's sets, its distinct classes (first document of each), and their node numbers."""

    def __init__(self, row: dict, n: int) -> None:
        self.chunk = chunk = Chunk(row)
        self.grams, self.at = gram_sets(chunk.buf, chunk.offsets, n)
        self.size = np.diff(self.at)
        self.fa, self.fb = self._sums(mix64(self.grams)), self._sums(mix64(self.grams ^ _U(0x5851F42D4C957F2D)) * _U(3))
        part, k = chunk.chunk_id >> 32, chunk.chunk_id & 0xFFFFFFFF
        self.node = ((part << 36) | (k << 16)) + np.arange(len(chunk), dtype=np.int64)
        order = np.lexsort((self.node, self.size, self.fb, self.fa))
        same = np.zeros(len(order), dtype=bool)
        if len(order):
            same[1:] = np.logical_and.reduce([x[order][1:] == x[order][:-1] for x in (self.fa, self.fb, self.size)])
        self.distinct = np.zeros(len(order), dtype=bool)
        self.distinct[order[~same]] = True
        self.distinct &= self.size > 0
        if "lead" in row:  # classes of which this chunk holds the first document of all
            leading = np.zeros(len(chunk), dtype=bool)
            leading[row["lead"] or []] = True
            self.distinct &= leading

    def _sums(self, x: np.ndarray) -> np.ndarray:
        """Of a number for each n-gram, each document's sum."""
        upto = np.zeros(len(x) + 1, dtype=_U)
        np.cumsum(x, out=upto[1:])
        return upto[self.at[1:]] - upto[self.at[:-1]]

    def of_classes(self) -> tuple[np.ndarray, np.ndarray]:
        """N-grams of the distinct classes, with each one's document."""
        keep = np.repeat(self.distinct, self.size)
        at = np.flatnonzero(self.distinct)
        return self.grams[keep], np.repeat(at.astype(np.int32), self.size[at])

    def asked(self) -> np.ndarray:
        """The sorted distinct 48-bit keys of the n-grams of the distinct classes."""
        return np.unique(mix64(self.of_classes()[0]) >> _U(16))

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """N-grams of the distinct classes and their documents, the sorted distinct 48-bit keys of the n-grams, and
        each n-gram's place among those. (Equal keys of different n-grams only make both look more common.)"""
        grams, doc = self.of_classes()
        keys = mix64(grams) >> _U(16)
        order = np.argsort(keys)
        keys = keys[order]
        new = np.ones(len(keys), dtype=bool)
        new[1:] = keys[1:] != keys[:-1]
        place = np.empty(len(keys), dtype=np.int32)
        place[order] = np.cumsum(new, dtype=np.int32) - 1
        return grams, doc, keys[new], place

    def first_grams(self, replies: list[bytes] | None, parts: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each class's first n-grams (in global order all but as many as a similar set must overlap, less one)
        those that stand in another class."""
        grams, doc, keys, place = self.keys()
        rarity = _unpacked(replies, np.diff(_key_bounds(keys, parts)))
        # In this chunk alone, but in several of its classes: such n-grams rank with those of two chunks.
        rarity[(rarity == 0) & (np.bincount(place, minlength=len(keys)) > 1)] = 1
        rarity = rarity[place]
        del keys, place
        order = np.lexsort((grams, rarity, doc))
        size = self.size[self.distinct]
        ends, first = np.cumsum(size), size - least_overlap(size, percent) + 1
        order = order[np.arange(len(order), dtype=np.int32) < np.repeat((ends - size + first).astype(np.int32), size)]
        order = order[rarity[order] > 0]
        return grams[order], doc[order]


def _key_bounds(keys: np.ndarray, parts: int) -> np.ndarray:
    return bounds(keys << _U(16), parts)


def _pack(keys: np.ndarray) -> bytes:
    """Sorted 48-bit keys as 32-bit steps; the rare longer steps keep their high bits apart."""
    step = np.diff(keys, prepend=_U(0))
    far = np.flatnonzero(step >> _U(32))
    head = np.array([len(far)], dtype=np.uint32)
    return b"".join((head.tobytes(), far.astype(np.uint32).tobytes(), (step[far] >> _U(32)).astype(np.uint32).tobytes(), step.astype(np.uint32).tobytes()))


def _unpack(data: bytes) -> np.ndarray:
    x = np.frombuffer(data, dtype=np.uint32)
    n = int(x[0])
    step = x[1 + 2 * n :].astype(_U)
    step[x[1 : 1 + n]] |= x[1 + n : 1 + 2 * n].astype(_U) << _U(32)
    return np.cumsum(step, dtype=_U)


def _chunk_counts(payloads: list[bytes]) -> list[bytes]:
    """Two bits per key: in one chunk, in 2 or 3, in up to 15, in more."""
    arrays = [_unpack(p) for p in payloads]
    _, place, counts = np.unique(np.concatenate(arrays), return_inverse=True, return_counts=True)
    level = np.searchsorted([2, 4, 16], counts, side="right").astype(np.uint8)[place]
    out, at = [], 0
    for a in arrays:
        part = level[at : at + len(a)]
        out.append(np.packbits(np.concatenate((part & 1, part >> 1))).tobytes())
        at += len(a)
    return out


def _unpacked(replies: list[bytes] | None, counts: np.ndarray) -> np.ndarray:
    out = [np.zeros(0, dtype=np.uint8)]
    for r, n in zip(replies or [], (int(c) for c in counts if c), strict=True):
        b = np.unpackbits(np.frombuffer(r, dtype=np.uint8), count=2 * n)
        out.append(b[:n] + 2 * b[n:])
    return np.concatenate(out)


def _star(keys: np.ndarray, nodes: np.ndarray, low: np.ndarray, high: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of a key's nodes by size (a node stands for sets of ``low`` to ``high`` n-grams), cut where sizes are too far
    apart for sets on both sides to be similar: each run's key, least node, least and greatest size, and the distinct
    (least, other) pairs of nodes in a run. Similar sets that share a key are in one run."""
    order = np.lexsort((nodes, high, low, keys))
    keys, nodes, low, high = keys[order], nodes[order], low[order], high[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    # The greatest size so far of a key: a key's sizes are lifted above those of the keys before.
    lift = np.cumsum(new) * (int(high.max(initial=0)) + 1)
    most = np.maximum.accumulate(high + lift) - lift
    new[1:] |= low[1:] * percent > 100 * most[:-1]
    at = np.flatnonzero(new)
    if not len(at):
        return keys, nodes, low, high, np.zeros((0, 2), dtype=np.int64)
    first = np.minimum.reduceat(nodes, at)
    least = first[np.cumsum(new) - 1]
    other = least != nodes
    pairs = np.unique(np.stack((least[other], nodes[other]), axis=1), axis=0)
    return keys[at], first, low[at], np.maximum.reduceat(high, at), pairs


class PrefixTree:
    """A trie of ordered sets with runs of single branches kept as one edge."""

    __slots__ = ("sets", "root")

    def __init__(self, sets: list[np.ndarray]) -> None:
        """``sets``: sorted, distinct arrays of small numbers in the global order."""
        self.sets = sets
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">i4").tobytes())
        # node: [from, to, set that spells the edge, children, sets that end here, least size, greatest size]
        self.root = [0, 0, order[0] if order else 0, [], [], 0, 0]
        path = [self.root]
        for prev, i in zip([None, *order], order, strict=False):
            s = sets[i]
            if prev is not None:
                common = _common(sets[prev], s)
                last = None
                while path[-1][1] > common:
                    last = path.pop()
                if path[-1][1] < common:  # cut the edge that was just left
                    middle = [path[-1][1], common, last[2], [last], [], 0, 0]
                    last[0] = common
                    path[-1][3][-1] = middle
                    path.append(middle)
            top = path[-1]
            if len(s) > top[1]:
                leaf = [top[1], len(s), i, [], [i], 0, 0]
                top[3].append(leaf)
                path.append(leaf)
            else:
                top[4].append(i)
        self._sizes(self.root)

    def _sizes(self, root: list) -> None:
        stack, done = [root], []
        while stack:
            node = stack.pop()
            done.append(node)
            stack += node[3]
        for node in reversed(done):
            sizes = [len(self.sets[i]) for i in node[4]] + [x for c in node[3] for x in c[5:7]]
            node[5], node[6] = (min(sizes), max(sizes)) if sizes else (0, 0)

    def search(self, query: np.ndarray, universe: int, percent: int) -> Iterator[int]:
        """Indices of all sets of which 100 * overlap >= percent * union with ``query``."""
        has = np.zeros(universe, dtype=np.int32)
        has[query] = 1
        upto = np.cumsum(has)
        ny, whole = len(query), 100 + percent
        stack = [(c, 0) for c in self.root[3]]
        while stack:
            (begin, end, spell, children, here, low, high), overlap = stack.pop()
            s = self.sets[spell]
            overlap += int(has[s[begin:end]].sum())
            # overlap needed with a set of size x: percent * (x + ny) / (100 + percent)
            missed = end - overlap  # of the path's n-grams
            if (high - missed) * whole < percent * (high + ny):
                continue
            skipped = int(upto[s[end - 1]]) - overlap  # of the query's n-grams up to here
            if (ny - skipped) * whole < percent * (low + ny):
                continue
            for i in here:
                if overlap * whole >= percent * (len(self.sets[i]) + ny):
                    yield i
            for c in children:
                stack.append((c, overlap))


def _common(a: np.ndarray, b: np.ndarray) -> int:
    m = min(len(a), len(b))
    differ = np.flatnonzero(a[:m] != b[:m])
    return int(differ[0]) if len(differ) else m


def join_family(texts: list[bytes], n: int, percent: int, side: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """Linked pairs (i, j), i < j, each once; with ``side`` only those between the two sides."""
    off = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    grams, at = gram_sets(np.frombuffer(b"".join(texts), dtype=np.uint8), off, n)
    distinct, place, counts = np.unique(grams, return_inverse=True, return_counts=True)
    order = np.empty(len(distinct), dtype=np.int64)
    order[np.lexsort((distinct, -counts))] = np.arange(len(distinct))  # frequent first: long shared paths
    ordered = order[place]
    sets = [np.sort(ordered[s:e]) for s, e in zip(at[:-1], at[1:], strict=True)]
    left = range(len(sets)) if side is None else np.flatnonzero(side == 0).tolist()
    tree = PrefixTree([sets[i] for i in left])
    for j in range(len(sets)) if side is None else np.flatnonzero(side == 1).tolist():
        for k in tree.search(sets[j], len(distinct), percent):
            i = left[k]
            if side is not None or i < j:
                yield i, j


class _Forest:
    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (p := self.up.get(root, root)) != root:
            root = p
        while x != root:
            self.up[x], x = root, self.up.get(x, x)
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: ``<id_col>, n_shingles, component_id, n_links``.

    Two rows are linked when 100 * overlap >= percent * union of their sets of ``n``-word shingles. Rows with no words
    (null, empty, blank) are linked with nothing. ``component_id``: the least id reachable by links; null ids are
    never the least, and a component of null ids alone has none. ``n_links`` counts linked rows, copies included.
    Equal ids stand for different rows. Extra columns are ignored.
    """
    spark = df.sparkSession
    table = chunks(df, id_col, text_col, "near")
    words = table.agg(F.sum("n_words")).first()[0] or 0

    def describe(batches):
        for row in rows_of(batches):
            s = _Sets(row, n)
            ids = pa.array(s.chunk.ids, mask=~s.chunk.known)
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(x.view(np.int64)) for x in (s.node, s.fa, s.fb, s.size.astype(np.int64)))], names=["id", "node", "fa", "fb", "size"])

    rows = stage(table.mapInArrow(tidy(describe), "id long, node long, fa long, fb long, size long"), "near-rows")
    kinds = rows.where("size > 0").groupBy("fa", "fb", "size").agg(F.min("node").alias("rep"), F.count("*").alias("copies"), F.min("id").alias("least_id"))
    kinds = stage(kinds, "near-classes")
    reps = rows.where("size > 0").join(kinds.select("fa", "fb", "size", "rep"), ["fa", "fb", "size"]).select("node", "rep")

    parts = parts_for(spark, words)
    # One chunk speaks for each class: copies send nothing.
    lead = stage(kinds.groupBy(_chunk_of("rep").alias("chunk_id")).agg(F.collect_list(_place_of("rep").cast("int")).alias("lead")), "near-lead")
    leading = table.join(F.broadcast(lead) if kinds.count() * 8 <= BROADCAST_BYTES else lead, "chunk_id", "left")

    def ask_counts(row):
        keys = _Sets(row, n).asked()
        cut = _key_bounds(keys, parts)
        for p, (b, e) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            if e > b:
                yield p, _pack(keys[b:e])

    told = with_replies(leading, ask(leading, ask_counts, _chunk_counts, "counts"), "counts")
    meeting = max(8, words // FIRST_GRAM_WORDS)

    def send(batches):
        for row in rows_of(batches):
            s = _Sets(row, n)
            grams, doc = s.first_grams(row["counts"], parts, percent)
            keys, *runs, pairs = _star(mix64(grams), s.node[doc], s.size[doc], s.size[doc], percent)  # first n-grams are low hashes: spread them again
            cut = bounds(keys, meeting)
            out = [(p, squeeze(b"".join(x[b:e].tobytes() for x in (keys, *runs)))) for p, (b, e) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if e > b]
            # Pairs found inside the chunk ride along to an answerer of the chunk's own.
            out.append((meeting + row["chunk_id"] % meeting, pairs.tobytes()))
            yield pa.RecordBatch.from_pydict({"p": [p for p, _ in out], "payload": [x for _, x in out]}, schema=pa.schema([("p", pa.int32()), ("payload", pa.binary())]))

    def meet(t: pa.Table) -> pa.Table:
        payloads = t.column("payload").to_pylist()
        if t.column("p")[0].as_py() >= meeting:
            pairs = np.frombuffer(b"".join(payloads), dtype=np.int64).reshape(-1, 2)
        else:
            keys, *runs = np.concatenate([np.frombuffer(unsqueeze(x), dtype=_U).reshape(4, -1) for x in payloads], axis=1)
            pairs = _star(keys, *(x.view(np.int64) for x in runs), percent)[4]
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    met = told.mapInArrow(tidy(send), "p int, payload binary").groupBy("p").applyInArrow(meet, "a long, b long")
    met = stage(met.distinct(), "near-met")
    by_rep = met.join(reps.withColumnsRenamed({"node": "a", "rep": "ra"}), "a").join(reps.withColumnsRenamed({"node": "b", "rep": "rb"}), "b")
    families = stage(components(by_rep.where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b"))), "near-families")
    links = _links(table, families, kinds, n, percent)
    joined = stage(components(links.where("a is not null").select("a", "b")), "near-components")
    degree = links.groupBy("node").agg(F.sum("links").alias("links")).where("node is not null")
    found = (
        kinds.join(joined, kinds["rep"] == joined["node"], "left")
        .select("fa", "fb", "size", "rep", "copies", "least_id", F.coalesce("label", "rep").alias("label"))
    )
    least = found.groupBy("label").agg(F.min("least_id").alias("component_id"))
    # Both staged, so that rows of a class or component of a third of all rows can be split in the joins below.
    least = stage(least, "near-least")
    final = stage(found.join(least, "label").join(degree, F.col("rep") == F.col("node"), "left").select("fa", "fb", "size", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "near-final")
    out = rows.join(final, ["fa", "fb", "size"], "left")
    return out.select(
        F.col("id").alias(id_col), F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )


def _chunk_of(node: str) -> Column:
    return F.shiftleft(F.shiftright(node, 36), 32) + F.shiftright(F.col(node), 16).bitwiseAND(F.lit((1 << 20) - 1))


def _place_of(node: str) -> Column:
    """The document's place in its chunk."""
    return F.col(node).bitwiseAND(F.lit(65535))


def _links(table: DataFrame, families: DataFrame, kinds: DataFrame, n: int, percent: int) -> DataFrame:
    """Rows (a, b) that span each family's linked classes, and rows (node, links) that count each class's links."""
    members = families.join(kinds.select(F.col("rep").alias("node"), "size", "copies"), "node")
    sizes = members.groupBy("label").agg(F.sum("size").alias("grams"), F.count("*").alias("sets"))
    blocks = F.greatest(F.ceil(F.col("grams") / BLOCK_GRAMS), F.ceil(F.col("sets") / BLOCK_SETS))
    sizes = stage(sizes.select("label", "grams", blocks.cast("int").alias("blocks")), "near-sizes")
    total = sizes.agg(F.sum(F.col("grams") * F.col("blocks"))).first()[0] or 0
    tasks = max(parts_for(table.sparkSession, 0), int(total // TASK_GRAMS) + 1)
    placed = members.join(sizes, "label").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    wanted = placed.groupBy(_chunk_of("node").alias("chunk_id")).agg(F.collect_list(F.struct(_place_of("node").alias("i"), "node", "label", "block", "blocks", "copies")).alias("wanted"))
    wanted = stage(wanted, "near-wanted")  # as many entries for a chunk as it has documents
    full = table.join(F.broadcast(wanted) if families.count() * 64 <= BROADCAST_BYTES else wanted, "chunk_id")

    def ship(batches):
        for row in rows_of(batches):
            chunk = Chunk(row)
            out = []
            for w in row["wanted"]:
                text, block, blocks = squeeze(b" ".join(chunk.text(w["i"]).split())), w["block"], w["blocks"]
                for other in range(blocks):
                    i, j = min(block, other), max(block, other)
                    out.append((int(mix64(np.array([w["label"] + (i << 44) + (j << 24)], dtype=np.int64).view(_U))[0] % _U(tasks)), w["label"], i, j, int(block == j and i != j), w["node"], w["copies"], text))
            for at in range(0, len(out), 4096):
                part = list(zip(*out[at : at + 4096], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(part, _SHIP, strict=True)], schema=_SHIP)

    def join(t: pa.Table) -> pa.Table:
        forest, links, span = _Forest(), {}, []
        for group in _groups_of(t):
            nodes, copies, texts = group["node"], group["copies"], [unsqueeze(x) for x in group["text"]]
            side = None if group["i"] == group["j"] else np.array(group["side"])
            for x, y in join_family(texts, n, percent, side):
                a, b = nodes[x], nodes[y]
                links[a] = links.get(a, 0) + copies[y]
                links[b] = links.get(b, 0) + copies[x]
                if forest.join(a, b):
                    span.append((a, b))
        forget()
        a = [x for x, _ in span] + [None] * len(links)
        b = [y for _, y in span] + [None] * len(links)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "node": pa.array([None] * len(span) + list(links), pa.int64()), "links": pa.array([None] * len(span) + list(links.values()), pa.int64())})

    shipped = full.mapInArrow(tidy(ship), "task long, label long, i int, j int, side int, node long, copies long, text binary")
    return stage(shipped.groupBy("task").applyInArrow(join, "a long, b long, node long, links long"), "near-links")


_SHIP = pa.schema([("task", pa.int64()), ("label", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("side", pa.int32()), ("node", pa.int64()), ("copies", pa.int64()), ("text", pa.binary())])


def _groups_of(t: pa.Table) -> Iterator[dict]:
    """The task's (family, block pair) groups, each in node order."""
    t = t.sort_by([("label", "ascending"), ("i", "ascending"), ("j", "ascending"), ("node", "ascending")])
    keys = np.stack([t.column(c).to_numpy().astype(np.int64) for c in ("label", "i", "j")])
    cut = np.flatnonzero(np.any(keys[:, 1:] != keys[:, :-1], axis=0)) + 1
    for s, e in zip([0, *cut.tolist()], [*cut.tolist(), t.num_rows], strict=True):
        part = t.slice(s, e - s)
        yield {"i": int(keys[1, s]), "j": int(keys[2, s])} | {c: part.column(c).to_pylist() for c in ("node", "copies", "side", "text")}


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``df`` whose id is their component's least; rows without words or id stay. Ids are unique."""
    found = near_duplicates(df, id_col, text_col, n, percent).where(F.col(id_col) != F.col("component_id"))
    gone = stage(found.select(F.col(id_col).alias("_gone")).distinct(), "near-gone")
    rows = gone.count()
    return df.join(F.broadcast(gone) if rows * 16 <= BROADCAST_BYTES else gone, df[id_col] == gone["_gone"], "left_anti")
