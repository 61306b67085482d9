"""Encoding, language models, language identification and search against plain versions."""

import collections
import fractions
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from veilspark.llm import bpe, language_id, lm_scoring, topk_search

SCHEMA = "doc_id long, text string, lang string, source string, score double, rank int"


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(bpe.default_path())


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(bpe.default_path())


AWKWARD = ["", " ", "  a", "a  b", "a \n b", "a\n\nb ", "I'll you've 'S x's", "<|endoftext|>a<|endoftext|> <|endoftext|>", "é😀漢字\x00\x1c\x85　x", "a" * 5000, "ab " * 4000, "x\ty z", "1234567 ½²", "﻿​"]


def test_codec_matches(vocabulary, reference):
    rnd = random.Random(2)
    alphabet = "abcXYZ  \n\t'.,!0123éß漢😀 s"
    texts = AWKWARD + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 120))) for _ in range(400)]
    words = sorted({w for t in texts for w in bpe._pattern().findall(t)})[::2]
    lexicon = bpe.Transducer.mapped(bpe.Transducer.compiled({w.encode(): vocabulary.merge(w.encode()) for w in words}))
    assert all(lexicon.find(w.encode()) == vocabulary.merge(w.encode()) for w in words)
    assert lexicon.find(b"not a word of it") is None
    codec = bpe.Codec(vocabulary, lexicon)
    for t in texts:
        ids = reference.encode(t, add_special_tokens=False).ids
        assert codec.encode(t) == ids
        assert codec.decode(ids) == reference.decode(ids, skip_special_tokens=False) == t


def test_long_and_short_merges_agree(vocabulary):
    rnd = random.Random(3)
    for _ in range(200):
        w = bytes(rnd.choice(b"abetn ros") for _ in range(rnd.randint(2, 48)))
        ids = [vocabulary.byte_ids[b] for b in w]
        assert vocabulary._merge_short([*ids]) == vocabulary._merge_long([*ids])


def test_transducer_shares_suffixes():
    words = {w: [i] for i, w in enumerate([b"tapping", b"topping", b"top", b"tap", b"zapping"])}
    data = bpe.Transducer.compiled(words)
    t = bpe.Transducer(data)
    assert {w: t.find(w) for w in words} == words
    assert len(t.final) < 1 + sum(len(w) for w in words) // 2
    assert bpe.Transducer(bpe.Transducer.compiled({})).find(b"a") is None


def test_round_trip(spark, reference):
    rows = [(i, t, "en", "s", 0.0, 1) for i, t in enumerate(AWKWARD)] + [(None, None, None, None, None, None), (3, "a  b", None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    e = bpe.Encoder(df, bpe.default_path())
    want = collections.Counter()
    for r in rows:
        ids = reference.encode(r[1] or "", add_special_tokens=False).ids
        want[r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()] += 1
    assert collections.Counter(tuple(r) for r in e.round_trip(df).collect()) == want
    back = e.decode(e.encode(df).drop("text")).select("doc_id", "text").collect()
    assert sorted(map(repr, ((r[0], r[1] or "") for r in rows))) == sorted(repr((r[0], r[1])) for r in back)
    empty = spark.createDataFrame([], SCHEMA)
    assert bpe.Encoder(empty, bpe.default_path()).round_trip(empty).collect() == []


def plain_lm(tokens, training, strengths):
    """The automaton as a dictionary of states, walked a token at a time."""
    order = len(strengths) + 1
    c = collections.Counter()
    for w in training:
        w = ["<s>", *w]
        c[()] += len(w) - 1
        for i in range(len(w)):
            for k in range(1, order + 1):
                if i - k + 1 >= 0:
                    c[tuple(w[i - k + 1 : i + 1])] += 1
    v = sum(len(k) == 1 and k != ("<s>",) for k in c)
    mu = lambda h: strengths[len(h) - 1]

    def p(h, x):
        return (c[h + (x,)] + mu(h) * p(h[1:], x)) / (c[h] + mu(h)) if h else (c[x,] + 0.5) / (c[()] + 0.5 * (v + 1))

    def walk(w):
        state, total = ("<s>",), 0.0
        for x in w:
            while state and not c[state + (x,)]:
                total += math.log10(mu(state) / (c[state] + mu(state)))
                state = state[1:]
            total += math.log10(p(state, x))
            state = (state + (x,))[-(order - 1) :] if c[x,] else ()
        return total

    return c, v, p, walk


@pytest.mark.parametrize("strengths,lane", [((50.0, 5.0), 256), ((50.0, 5.0), 7), ((3.0,), 5), ((9.0, 4.0, 2.0), 6)])
def test_lm(spark, strengths, lane, monkeypatch):
    monkeypatch.setattr(lm_scoring, "LANE", lane)
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choice("The the cat dog runs Sees a".split()) for _ in range(rnd.randint(0, 30))), "en", "s", 0.0, 0) for i in range(50)]
    rows += [(60, None, None, None, None, None), (61, " \n", "en", "s", 0.0, 0), (None, "the cat", "en", "s", 0.0, 0), (5, rows[5][1], "en", "s", 0.0, 0)]
    rows += [(70, "the Cat sees " * 3000 + "é ß", "en", "s", 0.0, 0), (71, "x" * 100_000, "en", "s", 0.0, 0)]
    got = lm_scoring.score(spark.createDataFrame(rows, SCHEMA).repartition(3), strengths=strengths).collect()
    tokens = [(r[0], (r[1] or "").encode().lower().split() + [None]) for r in rows]
    out_of = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1
    c, v, p, walk = plain_lm(tokens, [w for i, w in tokens if not out_of(i)], strengths)
    n = c[()]
    want = [(i, out_of(i), len(w), sum(c[x,] > 0 for x in w), n, sum(math.log10(p((), x)) for x in w), walk(w)) for i, w in tokens]
    key = lambda r: (r[0] is None, r[0] or 0)
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], abs=1e-6, rel=1e-9)
    # a proper distribution: over all known tokens and one unseen
    for h in (("<s>",), (b"the",), (b"cat", b"sees"))[: len(strengths) + 1]:
        if len(h) < len(strengths) + 1:
            assert sum(p(h, x) for x in [*(k[0] for k in c if len(k) == 1 and k != ("<s>",)), b"?"]) == pytest.approx(1)
    assert lm_scoring.score(spark.createDataFrame([], SCHEMA)).collect() == []


def test_packed_keys():
    from veilspark.llm import _exchange

    rnd = np.random.default_rng(1)
    for bits, n in ((8, 40), (40, 1000), (64, 5000), (64, 1), (64, 0)):
        keys = np.unique(rnd.integers(0, 1 << bits, n, dtype=np.uint64, endpoint=False) if bits < 64 else rnd.integers(0, (1 << 64) - 1, n, dtype=np.uint64))
        assert _exchange.unpack_keys(_exchange.pack_keys(keys)).tolist() == keys.tolist()
    for top in (0, 200, 60_000, 1 << 20, 1 << 40):
        counts = rnd.integers(0, top + 1, 50)
        assert _exchange.unpack_counts(_exchange.pack_counts(counts)).tolist() == counts.tolist()


def test_language(spark):
    en, de = "the house and the dog went over there".split(), "das haus und der hund ging über die straße".split()
    rnd = random.Random(6)
    rows = [(i, " ".join(rnd.choice(en if i % 2 else de) for _ in range(20)), "en" if i % 2 else "de", "s", 0.0, 0) for i in range(80)]
    more = [(100, None, "en", None, None, None), (101, "123 !!", None, None, None, None), (102, "thereover", None, None, None, None), (103, "straßenhund", None, None, None, None), (None, "the dog", None, None, None, None)]
    df = spark.createDataFrame(rows + more, SCHEMA)
    got = {r["doc_id"]: r for r in language_id.identify(df).collect()}
    assert all(got[i]["lang_pred"] == r for i, _, r, *_ in rows)
    assert [got[i]["lang_pred"] for i in (100, 101, 102, 103, None)] == ["und", "und", "en", "de", "en"]
    assert got[100]["score"] == 0 and all(0 <= r["score"] <= 1 for r in got.values())
    none = language_id.identify(df.where("lang is null")).collect()
    assert {r["lang_pred"] for r in none} == {"und"}


def plain_language(training, texts):
    """Word first, then ever shorter n-grams, one word at a time."""
    find = regex.compile(r"[\p{L}\p{M}]+").findall
    grams = lambda w, n: [w] if n == 0 else [f" {w} "[i : i + n] for i in range(len(w) + 3 - n)]
    counts = [collections.defaultdict(collections.Counter) for _ in range(6)]
    for lang, text in training:
        for w in find(text.lower()):
            for n in range(6):
                counts[n][lang].update(grams(w, n))
    langs = sorted({lang for lang, _ in training})
    keys = [set().union(*c.values()) for c in counts]
    logs = lambda n, k: [math.log((counts[n][x][k] + 0.5) / (sum(counts[n][x].values()) + 0.5 * (len(keys[n]) + 1))) for x in langs]

    def word(w):
        for n in (0, 5, 4, 3, 2, 1):
            known = [logs(n, g) for g in grams(w, n) if g in keys[n]]
            if known:
                return [sum(x) / len(known) for x in zip(*known)]
        return [0.0] * len(langs)

    out = []
    for t in texts:
        words = find((t or "").lower())
        if not any(regex.search(r"\p{L}", w) for w in words):
            out.append(("und", 0.0))
            continue
        mean = [sum(x) / len(words) for x in zip(*map(word, words))]
        odds = [math.exp((m - max(mean)) * min(len(words), language_id.SHARPNESS)) for m in mean]
        best = mean.index(max(mean))
        out.append((langs[best], odds[best] / sum(odds)))
    return out


def test_language_against_plain(spark):
    rnd = random.Random(8)
    word = lambda letters: "".join(rnd.choice(letters) for _ in range(rnd.randint(1, 7)))
    alphabet = {"aa": "abcdeé", "bb": "defghé", "cc": "ghiaḷ̃"}
    rows = [(i, " ".join(word(alphabet[x]) for _ in range(rnd.randint(1, 25))), x) for i, x in enumerate(rnd.choice([*alphabet]) for _ in range(90))]
    more = [None, "", " 12 !", "\u0301", "zzz qq", "a" * 300_000 + " d", "ABC Éd\n" * 3000, rows[3][1], rows[3][1]]
    df = spark.createDataFrame([*rows, *((200 + i, t, None) for i, t in enumerate(more))], "doc_id long, text string, lang string").repartition(3)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(df).collect()}
    want = plain_language([(r[2], r[1]) for r in rows], [*(r[1] for r in rows), *more])
    for i, (lang, score) in zip([*range(90), *range(200, 200 + len(more))], want, strict=True):
        assert got[i] == (lang, pytest.approx(score, abs=1e-5)), i
    # wholly even evidence: the first language by code point
    even = spark.createDataFrame([(1, "one", "b"), (2, "two", "a"), (3, "three", None)], "doc_id long, text string, lang string")
    assert {r["doc_id"]: r["lang_pred"] for r in language_id.identify(even, even.where("doc_id < 3")).collect()}[3] == "a"
    clash = df.withColumns({"score": F.lit("x"), "lang_pred": F.lit(1), "size": F.lit(2)})
    assert sorted(language_id.identify(clash).columns) == sorted(clash.columns)
    assert language_id.identify(df.limit(0)).collect() == []


def test_language_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("held_out", language_id.held_out())
    found = language_id.identify(docs, docs.where("not held_out")).where("held_out and lang is not null and lang_pred <> 'und'")
    n, right = found.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert n > 20 and right / n > 0.95


def brute_top(rows, k):
    ok = [(i, [math.floor(fractions.Fraction(x) * 1024) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, x in ok:
        if q % 10 == 0:
            scores = ((i, sum(a * b for a, b in zip(x, y))) for i, y in ok if i != q)
            best = sorted((-min(max(s, -(2**63)), 2**63 - 1), i) for i, s in scores)[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("group", [topk_search.GROUP_QUERIES, 3])
def test_top_k(spark, group):
    rnd = random.Random(7)
    rows = [(i, [float(np.float32(rnd.gauss(0, 1))) for _ in range(8)]) for i in range(120)]
    rows += [(i, [1.0] * 8) for i in range(200, 260)]  # ties
    rows += [(300, None), (301, [1.0, None] + [0.0] * 6), (302, [float("nan")] * 8), (303, [float("inf")] * 8), (None, [1.0] * 8), (310, [0.5, -0.25]), (311, [])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, score string, rank int").repartition(5)
    got = topk_search.top_k(df, F.col("vec_id") % 10 == 0, 10, group=group).collect()
    assert sorted(map(tuple, got)) == brute_top(rows, 10)
    assert topk_search.top_k(df.limit(0), F.col("vec_id") % 10 == 0).collect() == []
    few = spark.createDataFrame(rows[:4], "vec_id long, embedding array<float>")
    assert len(topk_search.top_k(few, F.col("vec_id") == 0, 10).collect()) == 3


def test_top_k_of_large_components(spark):
    rnd = random.Random(9)
    rows = [(i, [rnd.choice((1.0, 90_000.0, -90_000.0, 0.25)) * rnd.random() for _ in range(6)]) for i in range(60)]
    rows += [(100 + i, [rnd.choice((1e9, -3e12, 1e18, 2e5)) * rnd.random() for _ in range(6)]) for i in range(12)] + [(200, [1.7e308] * 6), (210, [-1.7e308] * 6), (220, [90_000.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert sorted(map(tuple, topk_search.top_k(df, F.col("vec_id") % 10 == 0, 10).collect())) == brute_top(rows, 10)


def test_cutoff_spares_pairs(spark):
    rnd = random.Random(10)
    # one in twenty vectors is long: the lists of a block are left early
    rows = [(i, [rnd.gauss(0, 1) * (8 if i % 20 == 0 else 0.2) for _ in range(16)]) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    met, resolved = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    got = topk_search.top_k(df, F.col("vec_id") % 100 == 0, 10, scored=(met, resolved)).collect()
    assert len(got) == 300 and met.value == 30 * 3000 and resolved.value < 0.1 * met.value
    x = np.floor(np.array([r[1] for r in rows]) * 1024).astype(np.int64)
    block = topk_search.Block(x[:1], x[:2000], 4)
    cutoff = np.array([np.sort(x[:1] @ x[1:2000].T)[0, -10] // 4])
    assert len(block.read(0, cutoff)[0]) < 300


def test_rare_languages_are_learned(spark):
    rows = [(i, "the quick brown fox", "en") for i in range(3000)] + [(5000 + i, f"zorp{'abcdefghij'[i]} glimf", "xx") for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    # far fewer rows than languages have; the whole vocabulary of what is taken stays
    for bound in ({"rows": 20}, {"size": 2_000}):
        assert language_id.fit(df, "doc_id", "text", "lang", **bound).languages == ["en", "xx"]
        got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(df, **bound).collect()}
        assert all(got[i] == "en" for i in range(3000)) and all(got[5000 + i] == "xx" for i in range(10))
    words = [f"w{a}{b}{c}" for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmnopqrst" for c in "abcdefg"]
    one = spark.createDataFrame([(1, " ".join(words), "yy")], "doc_id long, text string, lang string")
    assert len(language_id.fit(one, "doc_id", "text", "lang").tables[0].keys) == len(words)
