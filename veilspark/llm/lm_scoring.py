"""Language-model scoring with a weighted backoff automaton.

The model is an n-gram model in which every order is smoothed towards the next lower one with pseudo-counts, down to
the add-half unigram model: P(w | h) = (c(h w) + strength * P(w | h')) / (c(h) + strength), h' being h without its first
word. As an automaton: every n-gram of training that is shorter than the order is a state; a seen n-gram is an arc from
the state of its history, with its probability; every state has a failure arc to the state of h', of weight
strength / (c(h) + strength); the root has an arc for every token, one of them for all unseen ones. A traversal reads a
text once from left to right, carries the state, follows failure arcs until one leads on by the token, and adds log10
weights. The end of a text is a token, its beginning a state.

The whole automaton grows with the corpus, so no machine holds it. Each chunk of documents asks, order by order, for the
counts of its own distinct n-grams over all training documents; that is the part which its texts can reach, and it is
compiled and walked there. All texts of a chunk are walked in lock-step; long ones are cut into lanes, each with a
run-up of order - 1 tokens, after which the state no longer depends on where a walk began.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import tidy
from ._exchange import Chunk, ask, bounds, chunks, pack_counts, pack_keys, parts_for, rows_of, unpack_counts, unpack_keys, with_replies
from ._words import FOLD, mix64, word_hashes

_U = np.uint64
#: Hashes that stand for the end of a text (a token) and for its beginning (a state only).
END, BEGIN = _U(0x1BD11BDAA9FC1A22), _U(0x2545F4914F6CDD1D)
#: Pseudo-counts of the bigrams' and the trigrams' smoothing; the order is one more than there are of them.
STRENGTHS = (50.0, 5.0)
#: Keys of longer n-grams have so many bits more than the number of words has: two of 2 million share one, by chance.
SPARE_BITS = 21
#: Tokens of a lane.
LANE = 256


def held_out(ids: np.ndarray, known: np.ndarray, modulus: int, rest: int) -> np.ndarray:
    """Whether crc32 of the id's decimal text (null: empty text) leaves ``rest``."""
    return np.array([zlib.crc32(b"%d" % i if k else b"") % modulus == rest for i, k in zip(ids.tolist(), known.tolist(), strict=True)], dtype=bool)


class Tokens:
    """The token stream of a chunk: every document's words, A-Z lower-cased, and one end each."""

    def __init__(self, row: dict, modulus: int, rest: int) -> None:
        self.chunk = chunk = Chunk(row)
        words = word_hashes(FOLD[chunk.buf], chunk.starts, chunk.ends)
        n_docs = len(chunk)
        self.first = chunk.first + np.arange(n_docs + 1)
        total = int(self.first[-1])
        is_end = np.zeros(total, dtype=bool)
        is_end[self.first[1:] - 1] = True
        self.tokens = np.empty(total, dtype=_U)
        self.tokens[is_end] = END
        self.tokens[~is_end] = words
        self.held_out = held_out(chunk.ids, chunk.known, modulus, rest)
        self.train = np.repeat(~self.held_out, np.diff(self.first))
        #: Each token's place in its document.
        self.depth = np.arange(total) - np.repeat(self.first[:-1], np.diff(self.first))

    def grams(self, order: int, shift: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the ``order``-grams that end at the positions returned beside. The beginning counts as a token, and
        no n-gram reaches beyond it."""
        keys = self.tokens
        for k in range(2, order + 1):
            before = np.empty_like(keys)
            before[1:] = keys[:-1]
            if k == 2:
                before[self.first[:-1]] = BEGIN
            keys = mix64(before * _U(0x9E3779B97F4A7C15) + self.tokens)
        at = np.flatnonzero(self.depth >= order - 2)
        return (keys[at] >> _U(shift) if order > 1 else keys[at]), at

    def counted(self, order: int, shift: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys, sorted, and their counts in training documents."""
        keys, at = self.grams(order, shift)
        keys, place = np.unique(keys, return_inverse=True)
        return keys, np.bincount(place[self.train[at]], minlength=len(keys)).astype(np.int64)


def _totals(payloads: list[bytes]) -> list[bytes]:
    """Each key's count over all chunks; in front, the sum and the number of keys with a count, told once."""
    keys, counts = [], []
    for p in payloads:
        n = int.from_bytes(p[:8], "little")
        keys.append(unpack_keys(p[8 : 8 + n]))
        counts.append(unpack_counts(p[8 + n :]))
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.bincount(place, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.int64)
    out, at = [], 0
    for k, a in enumerate(keys):
        head = np.array([sums.sum(), np.count_nonzero(sums)] if k == 0 else [0, 0], dtype=np.int64)
        out.append(head.tobytes() + pack_counts(sums[place[at : at + len(a)]]))
        at += len(a)
    return out


def _unpacked(replies: list[bytes] | None) -> np.ndarray:
    return np.concatenate([np.zeros(0, dtype=np.int64)] + [unpack_counts(r[16:]) for r in replies or []])


def _head(replies: DataFrame, name: str) -> tuple[int, int]:
    """Sums of the two numbers in front of the replies (each answerer fills them in for one chunk only)."""

    def add(batches):
        for row in rows_of(batches):
            heads = np.array([np.frombuffer(r[:16], np.int64) for r in row[name]])
            yield pa.RecordBatch.from_pydict({"a": [int(heads[:, 0].sum())], "b": [int(heads[:, 1].sum())]})

    a, b = replies.select(name).mapInArrow(add, "a long, b long").agg(F.sum("a"), F.sum("b")).first()
    return a or 0, b or 0


class BackoffAutomaton:
    """The part of the automaton that one chunk's token stream can reach. State 0 is the root, 1 the beginning."""

    def __init__(self, t: Tokens, shift: int, counts: list[np.ndarray], total: int, distinct: int, begun: int, strengths: tuple[float, ...]) -> None:
        """``counts``: of each order, the counts of the chunk's distinct n-grams by key; ``begun``: training texts."""
        n = len(t.tokens)
        ids, sources, weights, targets = [], [], [], []
        fail_to, fail_weight = [np.zeros(2, dtype=np.int64)], [np.array([0.0, np.log10(strengths[0] / (begun + strengths[0]))])]
        states = 2  # so far
        for order, count in enumerate(counts, 1):
            keys, at = t.grams(order, shift)
            _, first, place = np.unique(keys, return_index=True, return_inverse=True)
            here = np.full(n, -1, dtype=np.int64)
            here[at] = place
            end = at[first]  # where one of each n-gram ends
            if order == 1:
                self.word = place
                p = (count + 0.5) / (total + 0.5 * (distinct + 1))
                self.root_weight = np.log10(p)
                self.root_to = np.where(count > 0, states + np.arange(len(count)), 0)
                suffix = np.zeros(len(count), dtype=np.int64)
            else:
                below = ids[-1]  # of the next lower order
                begins = t.depth[end] == 0
                history = np.where(begins, 1, base + below[end - 1])
                c = np.where(begins, begun, below_count[below[end - 1]])
                strength = strengths[order - 2]
                p = (count + strength * below_p[below[end]]) / (c + strength)
                suffix = base + below[end]
                seen = np.flatnonzero(count > 0)
                sources.append(history[seen] * len(counts[0]) + self.word[end[seen]])
                weights.append(np.log10(p[seen]))
                targets.append(states + seen if order < len(counts) else suffix[seen])
            if order < len(counts):
                fail_to.append(suffix)
                fail_weight.append(np.log10(strengths[order - 1] / (count + strengths[order - 1])))
                base, states = states, states + len(count)
                below_count, below_p = count, p
                ids.append(here)
        source = np.concatenate(sources)
        order = np.argsort(source, kind="stable")
        self.arc, self.weight, self.to = source[order], np.concatenate(weights)[order], np.concatenate(targets)[order]
        self.fail_to, self.fail_weight = np.concatenate(fail_to), np.concatenate(fail_weight)
        self.run_up = len(strengths)

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The weights and the new states of one token each."""
        weight, state, left = np.zeros(len(state)), state.copy(), np.arange(len(state))
        while len(left):
            s, w = state[left], word[left]
            at_root = s == 0
            root = left[at_root]
            weight[root] += self.root_weight[w[at_root]]
            state[root] = self.root_to[w[at_root]]
            left, s, w = left[~at_root], s[~at_root], w[~at_root]
            key = s * len(self.root_weight) + w
            arc = np.minimum(np.searchsorted(self.arc, key), max(len(self.arc) - 1, 0))
            found = self.arc[arc] == key if len(self.arc) else np.zeros(len(key), dtype=bool)
            on, arc = left[found], arc[found]
            weight[on] += self.weight[arc]
            state[on] = self.to[arc]
            left, s = left[~found], s[~found]
            weight[left] += self.fail_weight[s]
            state[left] = self.fail_to[s]
        return weight, state

    def walk(self, first: np.ndarray) -> np.ndarray:
        """The weight of every token, documents beginning at ``first`` (their end appended): left to right, a token of
        every lane at a time."""
        out = np.zeros(len(self.word))
        doc = np.repeat(np.arange(len(first) - 1), lanes := -(-np.diff(first) // LANE))
        lane = np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        begin = first[doc] + lane * LANE
        end = np.minimum(begin + LANE, first[doc + 1])
        run_up = np.where(lane > 0, self.run_up, 0)
        state = np.where(lane > 0, 0, 1)
        length = end - begin + run_up
        order = np.argsort(-length, kind="stable")
        begin, run_up, state, length = begin[order] - run_up[order], run_up[order], state[order], length[order]
        for k in range(int(length[0]) if len(length) else 0):
            n = int(np.searchsorted(-length, -k, side="left"))  # lanes longer than k
            at = begin[:n] + k
            weight, state = self.step(state[:n], self.word[at])
            counts = run_up[:n] <= k
            out[at[counts]] = weight[counts]
        return out


_OUT = pa.schema(
    [("id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
)


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 5, rest: int = 1, strengths: tuple[float, ...] = STRENGTHS) -> DataFrame:
    """One row per input row: ``<id_col>, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Learns from the rows whose crc32 of the id as text (null: empty) modulo ``modulus`` is not ``rest``. Null and blank
    texts are the end token alone. Equal rows count as often as they stand. Texts of any length are scored whole, one
    of more than some megabytes in a chunk of its own. Without training tokens every probability is that of an unseen
    token; an empty table gives no rows. Extra columns are ignored.
    """
    spark = df.sparkSession
    table = chunks(df, id_col, text_col, "lm")
    words, docs = table.agg(F.sum("n_words"), F.sum(F.octet_length("known"))).first()
    words, orders = (words or 0) + (docs or 0), len(strengths) + 1
    parts = parts_for(spark, words // 2)
    shift = max(0, 64 - words.bit_length() - SPARE_BITS)

    def questions(order: int):
        def of(row: dict) -> Iterator[tuple[int, bytes]]:
            keys, counts = Tokens(row, modulus, rest).counted(order, shift)
            cut = bounds(keys << _U(shift) if order > 1 else keys, parts)
            for p, (s, e) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                if e > s:
                    packed = pack_keys(keys[s:e])
                    yield p, len(packed).to_bytes(8, "little") + packed + pack_counts(counts[s:e])

        return of

    full, heads = table, []
    for order in range(1, orders + 1):
        replies = ask(table, questions(order), _totals, f"grams{order}")
        if order == 1:
            heads = _head(replies, "grams1")
        full = with_replies(full, replies, f"grams{order}", grows=True)
    train_tokens, distinct = heads
    begun = _training_rows(table, modulus, rest)

    def finish(batches):
        for row in rows_of(batches):
            t = Tokens(row, modulus, rest)
            counts = [_unpacked(row[f"grams{k}"]) for k in range(1, orders + 1)]
            automaton = BackoffAutomaton(t, shift, counts, train_tokens, distinct, begun, strengths)
            at, word = t.first[:-1], automaton.word
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(t.chunk.ids, mask=~t.chunk.known),
                    pa.array(t.held_out),
                    pa.array(np.diff(t.first)),
                    pa.array(np.add.reduceat((counts[0][word] > 0).astype(np.int64), at)),
                    pa.array(np.add.reduceat(automaton.root_weight[word], at)),
                    pa.array(np.add.reduceat(automaton.walk(t.first), at)),
                ],
                schema=_OUT,
            )

    out = full.mapInArrow(tidy(finish), "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(int(train_tokens)).cast("long").alias("train_tokens"), "base_score", "score")


def _training_rows(table: DataFrame, modulus: int, rest: int) -> int:
    def count(batches):
        for row in rows_of(batches):
            ids, known = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["known"], bool)
            yield pa.RecordBatch.from_pydict({"n": [int((~held_out(ids, known, modulus, rest)).sum())]})

    return table.select("ids", "known").mapInArrow(count, "n long").agg(F.sum("n")).first()[0] or 0
