"""Byte-level BPE encoding and decoding through a minimal acyclic transducer of frequent words.

The corpus's most frequent words are encoded once and compiled into an acyclic automaton that shares prefixes and
suffixes. Its arcs carry numbers that add up to a word's place in the lexicon, where its ids stand. The compiled form
is a few flat arrays in one blob of bounded size: the driver broadcasts it, each worker puts it into an unlinked file
of its own and maps that file.

Texts go through in slices of some megabytes. The distinct words of a slice walk the transducer together, byte by
byte; those that it does not know are merged exactly, by rank, all words of one length together (long words one by
one, in O(n log n)). Nothing is remembered from slice to slice, so memory follows the slice and the vocabulary alone.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import os
import struct
import tempfile
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ._common import bounded_batches, in_worker, stage, tidy
from ._words import slices

#: Words in the lexicon, at most. They change the speed only.
LEXICON_WORDS = 65_536
#: Bytes of text that are encoded, and counted, together; a longer text is taken alone.
SLICE_BYTES, COUNT_BYTES = 2 << 20, 8 << 20
#: Characters from which on a text is encoded in parts, where its blanks allow it.
LONG_CHARS = 1 << 20
#: Words up to this many bytes are merged together.
TOGETHER = 32
_BITS = 24
_MASK, _NEVER = (1 << _BITS) - 1, 1 << 62

# The published pre-tokenisation pattern of byte-level BPE, with Unicode white space spelled out.
_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"


def _byte_of_char() -> dict[str, int]:
    """Vocabulary files write each byte as a printable character: bytes that print as themselves in Latin-1, the
    others, in order, from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Ids, merges and special tokens of a tokenizer file, in a form that is cheap to send."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        chars = _byte_of_char()
        raw = lambda t: bytes(chars[c] for c in t)
        ids: dict[str, int] = data["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.pieces: list[bytes] = [b""] * size
        for t, i in ids.items():
            self.pieces[i] = raw(t)
        for t, i in self.special.items():
            self.pieces[i] = t.encode()
        single = {self.pieces[i]: i for t, i in ids.items() if len(t) == 1}
        self.byte_ids = [single[bytes([b])] for b in range(256)]
        # (left id, right id) -> (rank, merged id), both packed into one number
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(data["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[ids[a] << _BITS | ids[b]] = rank << _BITS | ids[a + b]

        # The merges again, as an open hash table, and those of two bytes as a full table.
        keys = np.fromiter(self.merges, dtype=np.int64, count=len(self.merges))
        self._shift = 64 - max(1, int(keys.size * 2)).bit_length()
        self.table_keys = np.full(1 << (64 - self._shift), -1, dtype=np.int64)
        self.table = np.full(len(self.table_keys), _NEVER, dtype=np.int64)
        left = np.arange(len(keys))
        slot = self._slots(keys)
        values = np.fromiter(self.merges.values(), dtype=np.int64, count=len(keys))
        while len(left):
            free = self.table_keys[slot[left]] == -1
            _, first = np.unique(slot[left][free], return_index=True)
            won = left[free][first]
            self.table_keys[slot[won]], self.table[slot[won]] = keys[won], values[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            slot[left] = (slot[left] + 1) & (len(self.table) - 1)
        self.bytes = np.array(self.byte_ids, dtype=np.int32)
        two = np.arange(1 << 16)
        self.of_two = self.ranks(self.bytes[two >> 8], self.bytes[two & 255])
        self.piece_bytes, self.piece_from, self.piece_size = _flat(self.pieces)
        self.name_bytes, self.name_from, self.name_size = _flat([b"%d," % i for i in range(size)])

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self._shift)).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Packed rank and merged id of each pair of ids; _NEVER where there is no merge."""
        keys = a.astype(np.int64) << _BITS | b
        slot = self._slots(keys)
        there = self.table_keys[slot]
        out = np.where(there == keys, self.table[slot], _NEVER)
        open_ = np.flatnonzero((there != keys) & (there != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.table) - 1)
            there = self.table_keys[slot[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = self.table[slot[open_[hit]]]
            open_ = open_[~hit & (there != -1)]
        return out

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word: the adjacent pair of lowest rank, leftmost first, is merged until none is known."""
        ids = [self.byte_ids[b] for b in word]
        return self._merge_short(ids) if len(ids) <= 48 else self._merge_long(ids)

    def merge_together(self, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """As ``merge`` for the rows of a matrix of bytes: (rows, ids), rows of equal numbers of ids together. A round
        merges one pair of every row that has any left, so that all of those rows stay of one length."""
        ids, rows = self.bytes[words], np.arange(len(words))
        ranks = self.of_two[words[:, :-1].astype(np.int32) << 8 | words[:, 1:]]
        while ids.shape[1] > 1:
            i = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), i]
            done = best == _NEVER
            if done.any():
                yield rows[done], ids[done]
                go = ~done
                rows, ids, ranks, i, best = rows[go], ids[go], ranks[go], i[go], best[go]
            n, width = len(rows), ids.shape[1] - 1
            if not n:
                return
            column = np.arange(width + 1)
            ids = ids[column != i[:, None] + 1].reshape(n, width)
            ranks = ranks[column[:width] != i[:, None]].reshape(n, width - 1)
            row = np.arange(n)
            ids[row, i] = best & _MASK
            for at, right in ((np.flatnonzero(i > 0), 0), (np.flatnonzero(i < width - 1), 1)):
                j = i[at] + right
                ranks[at, j - 1] = self.ranks(ids[at, j - 1], ids[at, j])
        if len(rows):
            yield rows, ids

    def _merge_short(self, ids: list[int]) -> list[int]:
        get = self.merges.get
        ranks = [get(a << _BITS | b, _NEVER) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks and (m := min(ranks)) != _NEVER:
            i = ranks.index(m)
            ids[i] = m & _MASK
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << _BITS | ids[i], _NEVER)
            if i < len(ranks):
                ranks[i] = get(ids[i] << _BITS | ids[i + 1], _NEVER)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """With a heap and links between neighbours: O(n log n)."""
        get, n = self.merges.get, len(ids)
        heap = [(m >> _BITS, i, m & _MASK, ids[i], ids[i + 1]) for i in range(n - 1) if (m := get(ids[i] << _BITS | ids[i + 1]))]
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            if ids[i] != a or (j := after[i]) >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if m := get(new << _BITS | ids[k]):
                    heapq.heappush(heap, (m >> _BITS, i, m & _MASK, new, ids[k]))
            if (h := before[i]) >= 0 and (m := get(ids[h] << _BITS | new)):
                heapq.heappush(heap, (m >> _BITS, h, m & _MASK, ids[h], new))
        return [i for i in ids if i >= 0]


def _flat(items: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Items end to end, where each begins and how long it is."""
    size = np.fromiter(map(len, items), dtype=np.int64, count=len(items))
    return np.frombuffer(b"".join(items), dtype=np.uint8), np.cumsum(size) - size, size


def _sums(size: np.ndarray) -> np.ndarray:
    """Running sums from 0 on."""
    out = np.zeros(len(size) + 1, dtype=np.int64)
    np.cumsum(size, out=out[1:])
    return out


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of all the ranges, end to end."""
    at = _sums(size)
    kind = np.int32 if int(at[-1]) + int(begin.max(initial=0)) < 1 << 31 else np.int64
    out = np.repeat((begin - at[:-1]).astype(kind), size)
    out += np.arange(len(out), dtype=kind)
    return out


class Transducer:
    """The compiled lexicon. ``find_all`` walks many words at once, ``find(word)`` gives a word's ids or None."""

    _HEAD = struct.Struct("<4Q")

    def __init__(self, data: bytes | mmap.mmap) -> None:
        states, arcs, words, ids = self._HEAD.unpack_from(data, 0)
        at = self._HEAD.size

        def part(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, dtype=kind, count=n, offset=at)
            at += -(-out.nbytes // 8) * 8
            return out

        # Views of the mapped file: nothing is copied.
        self.final = part("B", states)
        self.arc = part("I", arcs)
        self.target = part("I", arcs)
        self.skip = part("I", arcs)
        self.ids_from = part("I", words + 1)
        self.ids = part("I", ids)

    def find_all(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Each word's place in the lexicon, or -1: all words take a step with every byte, and leave where there is
        no arc. An arc is found by its state and byte."""
        out = np.full(len(begin), -1, dtype=np.int64)
        word = np.flatnonzero(size > 0) if len(self.arc) else np.zeros(0, dtype=np.int64)
        state, place, step = np.zeros(len(word), dtype=np.uint32), np.zeros(len(word), dtype=np.int64), 0
        while len(word):
            key = state << np.uint32(8) | data[begin[word] + step]
            arc = np.minimum(np.searchsorted(self.arc, key), len(self.arc) - 1)
            go = self.arc[arc] == key
            word, arc = word[go], arc[go]
            place, state, step = place[go] + self.skip[arc], self.target[arc], step + 1
            end = size[word] == step
            at = end & (self.final[state] > 0)
            out[word[at]] = place[at]
            word, place, state = word[~end], place[~end], state[~end]
        return out

    def find(self, word: bytes) -> list[int] | None:
        place = self.find_all(np.frombuffer(word, dtype=np.uint8), np.zeros(1, dtype=np.int64), np.array([len(word)]))[0]
        return None if place < 0 else self.ids[self.ids_from[place] : self.ids_from[place + 1]].tolist()

    @classmethod
    def compiled(cls, lexicon: dict[bytes, list[int]]) -> bytes:
        """Builds the minimal automaton from the sorted words, each new word freezing the states that no later word
        can reach, and packs it."""
        register: dict[tuple, int] = {}
        frozen: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

        def freeze(node: list) -> int:
            key = (node[0], tuple(node[1]))
            if key not in register:
                register[key] = len(frozen)
                frozen.append(key)
            return register[key]

        words = sorted(lexicon)
        path, last = [[False, []]], b""
        for w in words:
            common = len(os.path.commonprefix([last, w]))
            while len(path) - 1 > common:
                done = path.pop()
                path[-1][1].append((last[len(path) - 1], freeze(done)))
            path += [[False, []] for _ in range(len(w) - common)]
            path[-1][0] = True
            last = w
        while len(path) > 1:
            done = path.pop()
            path[-1][1].append((last[len(path) - 1], freeze(done)))
        freeze(path[0])
        below = [0] * len(frozen)  # words accepted from a state on; targets are frozen before their sources
        for i, (final, arcs) in enumerate(frozen):
            below[i] = final + sum(below[t] for _, t in arcs)
        n = len(frozen)
        place = lambda i: n - 1 - i  # noqa: E731  the root was frozen last and becomes state 0
        finals, target, skip, arc = [], [], [], []
        for i in range(n - 1, -1, -1):
            final, arcs = frozen[i]
            passed = int(final)
            for label, t in arcs:
                arc.append(place(i) << 8 | label)  # rising, as states and labels are
                target.append(place(t))
                skip.append(passed)
                passed += below[t]
            finals.append(final)
        ids_from = np.concatenate(([0], np.cumsum([len(lexicon[w]) for w in words]))) if words else np.zeros(1)
        ids = [i for w in words for i in lexicon[w]]
        out = [cls._HEAD.pack(n, len(arc), len(words), len(ids))]
        for kind, values in (("u1", finals), ("<u4", arc), ("<u4", target), ("<u4", skip), ("<u4", ids_from), ("<u4", ids)):
            raw = np.asarray(values).astype(kind).tobytes()
            out.append(raw + b"\0" * (-len(raw) % 8))
        return b"".join(out)

    @classmethod
    def mapped(cls, data: bytes) -> Transducer:
        """The lexicon in a mapped file without a folder (or, where the system has none, an unlinked one)."""
        if hasattr(os, "memfd_create"):
            fd = os.memfd_create("lexicon")
        else:
            fd, path = tempfile.mkstemp()
            os.unlink(path)
        with os.fdopen(fd, "wb") as f:
            f.write(data)
            f.flush()
            return cls(mmap.mmap(f.fileno(), len(data), access=mmap.ACCESS_READ))


@lru_cache(maxsize=1)
def _pattern() -> regex.Pattern:
    return regex.compile(PATTERN)


def pieces(text: str, special: dict[str, int]) -> Iterator[tuple[str, int | None]]:
    """Runs of ordinary text (id None) and special tokens, longest first where they overlap."""
    if not any(t in text for t in special):
        if text:
            yield text, None
        return
    cut = "|".join(regex.escape(t) for t in sorted(special, key=len, reverse=True))
    for part in regex.split(f"({cut})", text):
        if part:
            yield part, special.get(part)


#: Blanks beside other white space: only elsewhere may a text be cut at its blanks before pre-tokenisation.
_CROWDED = rf"[{_WS}] | [{_WS}]".replace(r"\x85", r"\x{85}").replace(r"\xa0", r"\x{a0}").replace(r"\u", r"\x")
_CROWDED = regex.sub(r"\\x([0-9a-f]{4})", r"\\x{\1}", _CROWDED)  # as Arrow's patterns write code points


def _cut_at_blanks(text: str) -> Iterator[str]:
    """Parts of about LONG_CHARS, each but the first with the blank that it begins with: where no blank stands beside
    white space, every blank begins a word. Text without blanks goes whole."""
    at = 0
    while at < len(text):
        end = text.find(" ", at + LONG_CHARS)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


class Codec:
    """Encoder and decoder of one worker."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Transducer | None) -> None:
        self.vocabulary, self.lexicon = vocabulary, lexicon

    def _words(self, words: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of each word: end to end, where they begin, and how many. Through the transducer, or merged."""
        v = self.vocabulary
        data, begin, size = _flat([w.encode() for w in words])
        place = self.lexicon.find_all(data, begin, size) if self.lexicon else np.full(len(words), -1, dtype=np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for t in v.special.keys() & words.keys():  # never part of ordinary text
            place[words[t]] = -2
            found.append((np.array([words[t]]), np.array([[v.special[t]]], dtype=np.int32)))
        known = np.flatnonzero(place >= 0)
        n = np.zeros(len(words), dtype=np.int64)
        if self.lexicon:
            ids_from = self.lexicon.ids_from.astype(np.int64)
            n[known] = ids_from[place[known] + 1] - ids_from[place[known]]
        unseen = np.flatnonzero(place == -1)
        for length in np.unique(size[unseen]).tolist():
            of = unseen[size[unseen] == length]
            if length > TOGETHER:
                found += [(np.array([i]), np.array([v.merge(data[begin[i] : begin[i] + length].tobytes())], dtype=np.int32)) for i in of.tolist()]
            else:
                for at in range(0, len(of), 1 << 16):
                    part = of[at : at + (1 << 16)]
                    found += [(part[rows], ids) for rows, ids in v.merge_together(data[begin[part][:, None] + np.arange(length)])]
        for rows, ids in found:
            n[rows] = ids.shape[1]
        begin = np.cumsum(n) - n
        out = np.empty(int(n.sum()), dtype=np.int32)
        if len(known):
            out[_ranges(begin[known], n[known])] = self.lexicon.ids[_ranges(ids_from[place[known]], n[known])]
        for rows, ids in found:
            out[begin[rows][:, None] + np.arange(ids.shape[1])] = ids
        return out, begin, n

    def encode_all(self, texts: pa.Array, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: empty), end to end, and where each text's begin (and the end).

        A text is a row of parts: where single blanks stand between other characters each begins a word, so the text
        is cut there and each distinct part of the slice is taken apart once. Other texts, and those with special
        tokens, are taken apart as they stand, each of their words being a part. A long text alone goes in parts,
        unless it must go ``whole``.
        """
        findall = _pattern().findall
        texts = texts.fill_null("") if texts.null_count else texts
        odd = pc.match_substring_regex(texts, _CROWDED)
        for t in self.vocabulary.special:
            odd = pc.or_(odd, pc.match_substring(texts, t))
        odd = np.asarray(odd.to_numpy(zero_copy_only=False), dtype=bool)
        if not whole and len(texts) == 1 and not odd[0] and len(text := texts[0].as_py()) > LONG_CHARS:
            ids = np.concatenate([self.encode_all(pa.array([part], pa.string()), True)[0] for part in _cut_at_blanks(text)])
            return ids, np.array([0, len(ids)])
        words: dict[str, int] = defaultdict()
        words.default_factory = words.__len__
        plain = np.flatnonzero(~odd)
        split = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
        if isinstance(split, pa.ChunkedArray):
            split = split.combine_chunks()
        cut = split.offsets.to_numpy().astype(np.int64)
        coded = split.flatten().dictionary_encode()
        parts, kind = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        # The distinct parts as they stand after a blank. An empty one (a blank at an end) is the blank itself.
        solid = [k for k, p in enumerate(parts) if p]
        rows = []
        for at in range(0, len(solid), 1 << 16):
            found = findall(" " + " ".join(map(parts.__getitem__, solid[at : at + (1 << 16)])))
            rows.append(np.fromiter(map(words.__getitem__, found), dtype=np.int32, count=len(found)))
        if len(solid) < len(parts):
            solid.append(parts.index(""))
            rows.append(np.array([words[" "]], dtype=np.int32))
        after_blank = np.concatenate([np.zeros(0, dtype=np.int32), *rows])
        blank = np.fromiter((w[0] == " " for w in words), dtype=bool, count=len(words))
        cuts = np.append(np.flatnonzero(blank[after_blank]), len(after_blank))
        begin, count = np.empty(len(parts), dtype=np.int64), np.empty(len(parts), dtype=np.int64)
        begin[solid], count[solid] = cuts[:-1], np.diff(cuts)
        # Parts that begin a text have no blank before them.
        heads, starts = [], cut[:-1]
        for k in kind[starts].tolist():
            heads.append(np.fromiter(map(words.__getitem__, findall(parts[k])), dtype=np.int32))
        odd_words = [np.fromiter((words[w] for w in self._taken_apart(texts[i].as_py())), dtype=np.int32) for i in np.flatnonzero(odd).tolist()]
        size = np.fromiter(map(len, [*heads, *odd_words]), dtype=np.int64, count=len(texts))
        flat = np.concatenate([after_blank, *heads, *odd_words])
        extra = len(after_blank) + np.cumsum(size) - size
        part_from, part_size = begin[kind], count[kind]
        part_from[starts], part_size[starts] = extra[: len(plain)], size[: len(plain)]
        # Ranges of the plain texts' parts, then one range for each other text; put in the texts' order.
        all_from, all_size = np.concatenate((part_from, extra[len(plain) :])), np.concatenate((part_size, size[len(plain) :]))
        of = np.concatenate((np.repeat(plain, np.diff(cut)), np.flatnonzero(odd)))
        if odd.any():
            by = np.argsort(of, kind="stable")
            all_from, all_size, of = all_from[by], all_size[by], of[by]
        word = flat[_ranges(all_from, all_size)]
        del split, coded, kind, part_from, part_size
        words.default_factory = None  # else the words of a slice hold themselves, until a collection that hardly comes
        ids, id_from, id_size = self._words(words)
        size = id_size[word]
        text_ends = _sums(all_size)[np.searchsorted(of, np.arange(len(texts) + 1))]
        return ids[_ranges(id_from[word], size)], _sums(size)[text_ends]

    def _taken_apart(self, text: str) -> Iterator[str]:
        for part, special in pieces(text, self.vocabulary.special):
            if special is not None:
                yield part
            else:
                yield from (m[0] for m in _pattern().finditer(part))

    def encode(self, text: str) -> list[int]:
        return self.encode_all(pa.array([text], pa.string()))[0].tolist()

    def decode_all(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        v = self.vocabulary
        raw = v.piece_bytes[_ranges(v.piece_from[ids], v.piece_size[ids])].tobytes()
        at = _sums(v.piece_size[ids])[offsets].tolist()
        return [raw[s:e].decode("utf-8", "replace") for s, e in zip(at[:-1], at[1:], strict=True)]

    def decode(self, ids: Iterable[int]) -> str:
        ids = np.array(ids, dtype=np.int64)
        return self.decode_all(ids, np.array([0, len(ids)]))[0]

    def names(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Each text's ids in decimal, joined by commas."""
        v = self.vocabulary
        raw = v.name_bytes[_ranges(v.name_from[ids], v.name_size[ids])].tobytes()
        at = _sums(v.name_size[ids])[offsets].tolist()
        return [raw[s : e - 1] if e > s else b"" for s, e in zip(at[:-1], at[1:], strict=True)]


def frequent_words(df: DataFrame, text_col: str, most: int) -> list[str]:
    """The pre-tokens of the commonest words, counted over all texts cut at blanks: of up to ``most`` words, and of
    those that are equally common at the limit none. Pre-tokens are taken from a word as it stands after a blank."""

    def count(batches):
        for batch in batches:
            for rows, _, _ in slices(batch, text_col, COUNT_BYTES):
                split = pc.split_pattern(rows.column(0), " ")
                found = split.flatten().value_counts()
                yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts").cast(pa.int64())], names=["word", "n"])

    counted = stage(df.select(text_col).mapInArrow(tidy(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    # Distinct counts are few (their sum is at most the corpus): the least count that fits is found from them.
    least, total = None, 0
    for n, words in sorted(((r["n"], r["words"]) for r in counted.groupBy("n").agg(F.count("*").alias("words")).collect()), reverse=True):
        if total + words > most:
            break
        least, total = n, total + words
    found = [] if least is None else counted.where(F.col("n") >= least).select("word").collect()
    return sorted({t for r in found for t in _pattern().findall(" " + r["word"])})


class Encoder:
    """A vocabulary with the lexicon of a corpus, ready to be used on DataFrames."""

    def __init__(self, df: DataFrame, path: str, text_col: str = "text", lexicon_words: int = LEXICON_WORDS) -> None:
        bounded_batches(df.sparkSession)
        vocabulary = Vocabulary(path)
        words = frequent_words(df, text_col, lexicon_words)
        blob = Transducer.compiled({w.encode(): vocabulary.merge(w.encode()) for w in words})
        self._sent = df.sparkSession.sparkContext.broadcast((vocabulary, blob))

    def codec(self) -> Callable[[], Codec]:
        """A function that workers call; the codec is made once per worker process."""
        sent = self._sent

        def get() -> Codec:
            key = hashlib.sha1(sent.value[1]).digest()
            return in_worker(("bpe", key), lambda: Codec(sent.value[0], Transducer.mapped(sent.value[1])))

        return get

    def encode(self, df: DataFrame, text_col: str = "text", out_col: str = "ids") -> DataFrame:
        """``df`` with the ids of each whole text (null: of the empty text) in ``out_col``; a column of that name is
        replaced. Rows go through in slices of some megabytes of text, so that memory does not follow the batch size."""
        get = self.codec()
        kept = [c for c in df.columns if c != out_col]

        def run(batches):
            codec = get()
            for batch in batches:
                for rows, _, _ in slices(batch, text_col, SLICE_BYTES):
                    ids, offsets = codec.encode_all(rows.column(rows.schema.get_field_index(text_col)))
                    lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                    yield pa.RecordBatch.from_arrays([*rows.columns, lists], names=[*rows.schema.names, out_col])

        schema = StructType([*df.select(*kept).schema.fields, StructField(out_col, ArrayType(IntegerType()))])
        return df.select(*kept).mapInArrow(tidy(run), schema)

    def decode(self, df: DataFrame, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
        """``df`` with the text of each id array (null: empty text) in ``out_col``; ids must be of the vocabulary."""
        get = self.codec()

        @F.pandas_udf("string")
        def text(ids):
            codec = get()
            return ids.map(lambda x: codec.decode(() if x is None else x))

        return df.withColumn(out_col, text(F.col(ids_col)))

    def round_trip(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``<id_col>, n_tokens, ids_sha256, decoded_sha256`` of each row: encoded, then decoded from those ids."""
        get, kind = self.codec(), df.schema[id_col].dataType.simpleString()

        def digest(batches):
            codec = get()
            for batch in batches:
                for rows, _, _ in slices(batch, text_col, SLICE_BYTES):
                    ids, offsets = codec.encode_all(rows.column(1))
                    ids_sha = [hashlib.sha256(x).hexdigest() for x in codec.names(ids, offsets)]
                    text_sha = [hashlib.sha256(x.encode()).hexdigest() for x in codec.decode_all(ids, offsets)]
                    yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(offsets)), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

        return df.select(id_col, text_col).mapInArrow(tidy(digest), f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_path() -> str:
    """The tokenizer file of this installation's public_tokenizers package."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
