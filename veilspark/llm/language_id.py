"""Language identification, word first: known words score by their log frequency in each language, an unseen word
falls back to its longest known character n-grams, then to ever shorter ones.

Words and n-grams are counted and looked up by 64-bit hashes, many at once: the distinct words of a slice of texts are
scored together, and a text's score is the mean over its words. The model is the sample's whole vocabulary; of each
key only the languages that it was seen in are stored, so that its size is bounded by the sample's text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import crc_mod, forget, from_rows, stage, tidy
from ._words import doc_of_word, gram_hashes, inside, mix64, slices, text_buffer, word_hashes

#: Labelled rows that the classifier is fitted on, and bytes of their texts, at most about: rows are taken by a hash of
#: their id, with their whole texts.
TRAIN_ROWS, TRAIN_BYTES = 20_000, 48 << 20
#: But of each language at least about this many rows, or all it has.
LANG_ROWS = 1_000
LONGEST = 5
UNKNOWN = "und"
#: Words that the certainty of a text is judged by, at most: evidence beyond them does not sharpen the score.
SHARPNESS = 10
#: Distinct words that a task counts before it passes them on, and bytes of text that are scored together.
_FLUSH, _SLICE = 200_000, 2 << 20
_BETWEEN, _LETTER = r"[^\p{L}\p{M}]+", r"\p{L}"
_U = np.uint64


def words_in(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Runs of letters (with their marks), lower-cased: the distinct words, each word's place among them in text
    order, and each text's number of words."""
    lists = pc.split_pattern_regex(pc.utf8_lower(texts.fill_null("")), _BETWEEN)
    coded = lists.flatten().dictionary_encode()
    words, place = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    empty = pc.index(words, "").as_py()  # beside white space at a text's ends
    solid = place != empty
    size = np.diff(np.concatenate(([0], np.cumsum(solid)))[offsets - offsets[0]])
    if empty >= 0:
        words = words.filter(pc.not_equal(words, ""))
        place = place[solid]
        place -= place > empty
    return words, place, size


def word_keys(words: pa.Array) -> np.ndarray:
    data, offsets = text_buffer(words)
    return word_hashes(data, offsets[:-1], offsets[1:])


class Grams:
    """The characters of words, each word with one blank on either side."""

    def __init__(self, words: list[str]) -> None:
        text = "".join([f" {w} " for w in words])
        points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        self._points = mix64(points.astype(_U) + _U(1))
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
        self._first = np.concatenate(([0], np.cumsum(size)))

    def keys(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams of all words, and the word of each; of words too short for one, none."""
        at = np.flatnonzero(inside(self._first, n)[: max(0, len(self._points) - n + 1)])
        return gram_hashes(self._points, n)[at], doc_of_word(self._first)[at]


class Table:
    """Sorted keys, and the log frequency of each in the languages that have it; ``base`` is that of an absent key."""

    def __init__(self, lang: np.ndarray, keys: np.ndarray, counts: np.ndarray, languages: int) -> None:
        order = np.lexsort((lang, keys))
        lang, keys, counts = lang[order], keys[order], counts[order]
        self.keys, first = np.unique(keys, return_index=True)
        self.row_from = np.append(first, len(keys)).astype(np.int64)
        self.lang = lang.astype(np.int32)
        floor = np.log(np.bincount(lang, weights=counts, minlength=languages) + 0.5 * (len(self.keys) + 1))
        self.base = np.log(0.5) - floor
        self.gain = np.log(counts + 0.5) - np.log(0.5)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's row, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def means(self, rows: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """For each of ``n`` owners, the mean score of its rows (at least one) in every language."""
        size = self.row_from[rows + 1] - self.row_from[rows]
        ends = np.cumsum(size)
        entry = np.repeat(self.row_from[rows] - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)
        cell = np.repeat(owner, size) * len(self.base) + self.lang[entry]
        sums = np.bincount(cell, weights=self.gain[entry], minlength=n * len(self.base)).reshape(n, len(self.base))
        return sums / np.bincount(owner, minlength=n)[:, None] + self.base


class Model:
    """Per-language log frequencies of words (table 0) and of character n-grams (table n)."""

    def __init__(self, lang: np.ndarray, n: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> None:
        """Parallel arrays of languages (strings), lengths (0 for words), key hashes and counts."""
        self.languages, place = np.unique(lang.astype(object), return_inverse=True) if len(lang) else (np.zeros(0, dtype=object), lang)
        self.languages = self.languages.tolist()
        self.tables = {k: Table(place[n == k], keys[n == k], counts[n == k], len(self.languages)) for k in range(LONGEST + 1) if (n == k).any()}

    def scores(self, words: pa.Array) -> np.ndarray:
        """Log scores of each word in all languages: its own if known, else the mean over its known n-grams of the
        greatest length that has any; all alike if none is known."""
        out = np.zeros((len(words), len(self.languages)), dtype=np.float32)
        left = np.arange(len(words))
        if 0 in self.tables and len(words):
            at = self.tables[0].find(word_keys(words))
            known = np.flatnonzero(at >= 0)
            out[known] = self.tables[0].means(at[known], np.arange(len(known)), len(known))
            left = np.flatnonzero(at < 0)
        for n in range(LONGEST, 0, -1):
            if n not in self.tables or not len(left):
                continue
            keys, owner = Grams(words.take(pa.array(left)).to_pylist()).keys(n)
            at = self.tables[n].find(keys)
            hit = at >= 0
            has, owner = np.unique(owner[hit], return_inverse=True)
            out[left[has]] = self.tables[n].means(at[hit], owner, len(has))
            left = np.delete(left, has)
        return out

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; ``und`` with 0 for a text without letters, or when nothing was learned."""
        words, word, size = words_in(texts)
        has = np.concatenate(([0], np.cumsum(np.asarray(pc.match_substring_regex(words, _LETTER).to_numpy(zero_copy_only=False), dtype=bool)[word])))
        ends = np.cumsum(size)
        some = np.flatnonzero(has[ends] > has[ends - size]) if self.languages else ends[:0]
        names, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not len(some):
            return names, score
        scores, cuts = self.scores(words), np.stack(((ends - size)[some], ends[some]), axis=1).ravel()
        # A language at a time, so that no matrix of all words and languages is made; its last sum may end the words.
        mean = np.stack([np.add.reduceat(np.append(scores[:, k][word].astype(np.float64), 0.0), cuts)[::2] for k in range(len(self.languages))], axis=1) / size[some][:, None]
        odds = np.exp((mean - mean.max(axis=1, keepdims=True)) * np.minimum(size[some], SHARPNESS)[:, None])
        best = mean.argmax(axis=1)
        score[some] = odds[np.arange(len(some)), best] / odds.sum(axis=1)
        for i, k in zip(some.tolist(), best.tolist(), strict=True):
            names[i] = self.languages[k]
        return names, score


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, n, key, count``: words and, from each distinct word once, its n-grams."""
    held: dict[str, pa.Table] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, table in held.items():
            words, times = table.column("word").combine_chunks(), table.column("n").to_numpy()
            grams = Grams(words.to_pylist())
            for n in range(LONGEST + 1):
                keys, owner = grams.keys(n) if n else (word_keys(words), np.arange(len(words)))
                keys, place = np.unique(keys, return_inverse=True)
                counts = np.bincount(place, weights=times[owner], minlength=len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(np.full(len(keys), n, dtype=np.int32)), pa.array(keys.view(np.int64)), pa.array(counts)], names=["lang", "n", "key", "count"])
        held.clear()

    for batch in batches:
        for rows, _, _ in slices(batch, "text", _SLICE):
            for lang in pc.unique(rows.column(0)).to_pylist():
                words, place, _ = words_in(rows.filter(pc.equal(rows.column(0), lang)).column(1))
                table = pa.table({"word": words, "n": np.bincount(place, minlength=len(words)).astype(np.int64)})
                if lang in held:
                    table = pa.concat_tables([held[lang], table]).group_by("word").aggregate([("n", "sum")]).rename_columns({"n_sum": "n"})
                held[lang] = table
            if sum(t.num_rows for t in held.values()) > _FLUSH:
                yield from flush()
    yield from flush()


def sample(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, rows: int = TRAIN_ROWS, size: int = TRAIN_BYTES) -> DataFrame:
    """``lang, text`` of the labelled rows (language and text not null) to learn from. With more than ``rows`` of them,
    or more than ``size`` bytes of text, those with the least hash of their id are taken, about that many; of a
    language that would have fewer than LANG_ROWS, that many or all."""
    spread = 1 << 20
    lang, at = F.col(lang_col).cast("string"), F.pmod(F.xxhash64(id_col), F.lit(spread))
    usable = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(lang.alias("lang"), F.col(text_col).alias("text"), at.alias("_at"))
    found = usable.groupBy("lang").agg(F.count("*").alias("n"), F.min("_at").alias("least"), F.sum(F.octet_length("text")).alias("size")).collect()  # a row per language
    share = min(rows / max(1, sum(r["n"] for r in found)), size / max(1, sum(r["size"] for r in found)))
    if share < 1:
        cut = [(r["lang"], max(r["least"] + 1, int(spread * max(share, LANG_ROWS / r["n"])))) for r in found]
        cuts = F.broadcast(from_rows(labelled.sparkSession, cut, "lang string, _cut long"))
        usable = usable.join(cuts, "lang").where(F.col("_at") < F.col("_cut"))
    return usable.select("lang", "text")


def fit(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, rows: int = TRAIN_ROWS, size: int = TRAIN_BYTES) -> Model:
    """The model of the whole vocabulary of the sampled rows."""
    counted = sample(labelled, id_col, text_col, lang_col, rows, size).mapInArrow(tidy(_count), "lang string, n int, key long, count long").groupBy("lang", "n", "key").agg(F.sum("count").alias("count"))
    got = stage(counted, "language-counts").toArrow()  # bounded by the sample's text
    lang = got.column("lang").combine_chunks().dictionary_encode()
    names = np.array([*lang.dictionary.to_pylist()], dtype=object)
    return Model(names[lang.indices.to_numpy(zero_copy_only=False)] if len(names) else names, *(got.column(c).to_numpy() if c != "key" else got.column(c).to_numpy().view(_U) for c in ("n", "key", "count")))


def identify(df: DataFrame, training: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS, size: int = TRAIN_BYTES) -> DataFrame:
    """``df`` with ``lang_pred`` and ``score`` (0 to 1) for each whole text; columns of these names are replaced.

    Fitted on ``training`` (by default ``df`` itself), within the bounds ``rows`` and ``size`` of sample(). Null and
    empty texts and texts without letters are ``und`` with score 0, and so is everything when nothing could be
    learned; an empty table gives no rows. Equal texts get equal results. Texts are scored whole, in slices of some
    megabytes, a longer one alone. Ties go to the first language by code point.
    """
    model = fit(df if training is None else training, id_col, text_col, lang_col, rows, size)
    sent = df.sparkSession.sparkContext.broadcast(model)  # bounded by the sample's text
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64())])

    @F.arrow_udf("lang string, score double")
    def predict(texts: pa.Array) -> pa.Array:
        model = sent.value
        names, scores = [], []
        most = _SLICE * 8 // max(8, len(model.languages))
        for rows, _, _ in slices(pa.RecordBatch.from_arrays([texts], names=["text"]), "text", most):
            lang, score = model.predict(rows.column(0))
            names += lang
            scores.append(score)
        forget()
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate([np.zeros(0), *scores]))], fields=list(kind))

    # Filters on the result must not run it a second time, in a second worker.
    once = predict.asNondeterministic()
    return df.withColumn("_language", once(F.col(text_col))).withColumns({"lang_pred": F.col("_language.lang"), "score": F.col("_language.score")}).drop("_language")


def held_out(id_col: str = "doc_id", modulus: int = 3, rest: int = 1) -> Column:
    """Whether a row is kept out of the learning: by crc32 of its id as text (null: empty text)."""
    return crc_mod(id_col, modulus) == rest
