"""Exact dedup, substring dedup and the n-gram join against plain versions, with awkward rows."""

import collections
import hashlib
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark.llm import _components, exact_dedup, ngram_join, substring_dedup
from veilspark.llm._components import components
from veilspark.llm._common import from_rows
from veilspark.llm._exchange import squeeze, stable_order
from veilspark.llm._words import word_spans

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, count long, id string"
VOCAB = [f"w{i}" for i in range(40)]


def _rows(seed=1, n=60):
    rnd = random.Random(seed)
    base = [" ".join(rnd.choice(VOCAB) for _ in range(rnd.randint(1, 80))) for _ in range(n // 3)]
    texts = []
    for _ in range(n):
        words = rnd.choice(base).split()
        for _ in range(rnd.choice((0, 0, 1, 3))):
            words[rnd.randrange(len(words))] = rnd.choice(VOCAB)
        texts.append(rnd.choice((" ", "\n", "  ")).join(words))
    rows = [(i, t, "en", "s", len(t), 1, "x") for i, t in enumerate(texts)]
    rows += [(1000, None, None, None, None, None, None), (1001, "", "en", None, 0, 2, "y"), (1002, " \t\n", "en", "s", 3, 3, "z"), (None, texts[0], "en", "s", 0, 4, "n"), (7, texts[3], "en", "s", 0, 1, "r"), (7, texts[3], "en", "s", 0, 1, "r")]
    rows += [(2000, " ".join(f"long{i % 997}" for i in range(30_000)), "en", "s", 0, 0, "l"), (2001, " ".join(f"long{i % 997}" for i in range(30_000)) + " end", "en", "s", 0, 0, "l")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), SCHEMA).repartition(3)


def words(t):
    return (t or "").encode().split()


def test_exact(spark, docs):
    got = exact_dedup.exact_duplicates(docs).collect()
    rows = _rows()
    assert len(got) == len(rows)
    groups = collections.defaultdict(list)
    for r in rows:
        groups[b"".join(words(r[1]))].append(r)
    for r in got:
        mine = next(g for k, g in groups.items() if hashlib.sha256(k).hexdigest() == r["text_sha256"])
        best = min(mine, key=lambda x: (-len(x[1] or ""), x[0] is None, x[0] or 0))
        assert r["keep_id"] == best[0] and r["group_size"] == len(mine)
    assert sum(r["kept"] for r in got) == len(groups)
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)


def test_exact_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.exact_duplicates(empty).collect() == []
    assert exact_dedup.drop_exact_duplicates(empty).collect() == []


@pytest.mark.parametrize("top", [1, 40, 1 << 62])
def test_stable_order(top):
    """Also where many different keys share their leading bits (``top`` small), and for no keys."""
    rnd = np.random.default_rng(3)
    for n in (0, 1, 2, 5000):
        keys = rnd.integers(0, top + 1, n).astype(np.uint64)
        assert (stable_order(keys) == np.argsort(keys, kind="stable")).all()


def test_windows_with_one_lead():
    rnd = np.random.default_rng(4)
    lead, rest = rnd.integers(0, 9, 300).astype(np.uint64), rnd.integers(0, 3, 300).astype(np.uint32)
    order, new = substring_dedup._windows(lead, rest)
    pairs = list(zip(lead[order].tolist(), rest[order].tolist(), strict=True))
    assert pairs == sorted(pairs) and int(new.sum()) == len(set(pairs))


def test_codes_give_the_words_back():
    texts = [b"a b a", b"", b" \n", b"c  b"]
    offsets = np.cumsum([0, *map(len, texts)])
    buf = np.frombuffer(b"".join(texts), dtype=np.uint8)
    spans = word_spans(buf, offsets)
    row = dict(zip(substring_dedup._WORDS, substring_dedup._coded(buf, *spans), strict=True))
    hashes, first = substring_dedup._decoded(row)
    assert (hashes == substring_dedup.word_hashes(buf, spans[0], spans[1], 0)).all() and first.tolist() == [0, 3, 3, 3, 5]


def brute_substrings(rows, length):
    first = {}
    for r in rows:
        w = words(r[1])
        for i in range(len(w) - length + 1):
            k = tuple(w[i : i + length])
            if r[0] is not None and (k not in first or r[0] < first[k]):
                first[k] = r[0]
    out = []
    for r in rows:
        w = words(r[1])
        gone = [False] * len(w)
        if r[0] is not None:
            for i in range(len(w) - length + 1):
                if first[tuple(w[i : i + length])] < r[0]:
                    gone[i : i + length] = [True] * length
        out.append((r[0], len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return out


@pytest.mark.parametrize("extend", [False, True])
def test_substrings(spark, docs, extend):
    got = substring_dedup.remove_repeats(docs, extend=extend).select("doc_id", "n_words", "n_removed", "kept_text", "removed", "longest").collect()
    key = lambda x: repr(x)
    assert sorted((tuple(r)[:4] for r in got), key=key) == sorted(brute_substrings(_rows(), 13), key=key)
    assert all(r["n_removed"] == sum(s["end"] - s["start"] for s in r["removed"]) for r in got)
    if extend:
        assert {r["doc_id"]: r["longest"] for r in got}[2001] >= 13 * 1024


def test_substrings_empty(spark):
    assert substring_dedup.remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


def shingles(t, n=5):
    w = [x.lower() for x in words(t)]
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("block", [ngram_join.BLOCK_GRAMS, 150])
def test_join(spark, docs, block, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_GRAMS", block)  # small blocks: families are joined block by block
    got = ngram_join.near_duplicates(docs).collect()
    rows = _rows()
    sets = [shingles(r[1]) for r in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    links = collections.Counter()
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                up[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    want = sorted(repr((r[0], len(sets[i]), least.get(find(i)) if sets[i] else r[0], links[i])) for i, r in enumerate(rows))
    assert sorted(repr(tuple(r)) for r in got) == want
    assert ngram_join.one_of_each(docs).columns == docs.columns


def test_join_empty(spark):
    assert ngram_join.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_prefix_tree_search():
    import numpy as np

    rnd = random.Random(5)
    sets = [np.array(sorted(rnd.sample(range(60), rnd.randint(1, 30)))) for _ in range(80)]
    sets += [sets[0], sets[1]]
    tree = ngram_join.PrefixTree(sets)
    for q in sets:
        found = sorted(tree.search(q, 60, 60))
        assert found == [i for i, s in enumerate(sets) if 100 * len(set(s) & set(q)) >= 60 * len(set(s) | set(q))]


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (105, 101), (7, 7)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**dict.fromkeys(range(31), 0), **dict.fromkeys((100, 101, 105), 100)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_extra_columns_survive(spark, docs):
    assert exact_dedup.drop_exact_duplicates(docs.withColumn("size", F.lit(1))).columns[-1] == "size"


def test_runs_of_sizes():
    """A shared n-gram makes no family of sets whose sizes rule similarity out, and parts no sets that may be similar,
    also when chunks send runs of theirs."""
    size = np.array([10, 12, 100, 125, 126, 157])
    keys = np.zeros(6, dtype=np.uint64)
    runs = ngram_join._star(keys, np.arange(6), size, size, 80)
    assert runs[1].tolist() == [0, 2] and runs[4].tolist() == [[0, 1], [2, 3], [2, 4], [2, 5]]
    rng = np.random.default_rng(3)
    for _ in range(50):
        n = 40
        keys, size, chunk = rng.integers(0, 3, n).astype(np.uint64), np.exp(rng.uniform(0, 7, n)).astype(np.int64) + 1, rng.integers(0, 4, n)
        made = [ngram_join._star(keys[at], at, size[at], size[at], 80) for at in (np.flatnonzero(chunk == c) for c in range(4))]
        over = ngram_join._star(*(np.concatenate([m[k] for m in made]) for k in range(4)), 80)
        pairs = np.concatenate([m[4] for m in made] + [over[4]])
        label = dict(zip(*(x.tolist() for x in _components.least_reachable(pairs[:, 0], pairs[:, 1])), strict=True))
        for x in range(n):
            for y in range(n):
                if keys[x] == keys[y] and 100 * size[x] >= 80 * size[y] >= 80 * size[x]:
                    assert label.get(x, x) == label.get(y, y)


def test_components_by_rounds_and_at_once(spark, monkeypatch):
    rnd = random.Random(5)
    edges = [(i, i + 1) for i in range(30)] + [(rnd.randrange(100, 200), rnd.randrange(100, 200)) for _ in range(70)] + [(5, 5), (300, 300), (None, 4)]
    df = spark.createDataFrame(edges, "a long, b long")
    at_once = dict(components(df).collect())
    monkeypatch.setattr(_components, "LOCAL_EDGES", 0)
    assert dict(components(df).collect()) == at_once and at_once[30] == 0 and 300 not in at_once


def test_chunks_come_in_small_batches(spark):
    """Rows of the chunk table have megabytes: workers get few of them at a time."""
    from veilspark.llm._exchange import chunks

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    assert chunks(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), "doc_id", "text", "batches").count() == 1
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20


def chunk_row(texts):
    data, size = [t.encode() for t in texts], len(texts)
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in data]))).astype(np.int64)
    return {"chunk_id": 0, "ids": np.arange(size).tobytes(), "known": np.ones(size, dtype=bool).tobytes(), "offsets": offsets.tobytes(), "body": squeeze(b"".join(data))}


@pytest.mark.parametrize("most", [1, 300, 1 << 20])
def test_sets_of_a_chunk(most, monkeypatch):
    """Cut anywhere between documents the sets are the same; equal ones have one fingerprint wherever they stand."""
    monkeypatch.setattr(ngram_join, "GRAM_BYTES", most)
    rng = random.Random(3)
    texts = [" ".join(rng.choices("abcdefgh", k=rng.choice([0, 1, 4, 5, 40]))) for _ in range(150)]
    texts += [t.upper() for t in texts]
    s = ngram_join._Sets(chunk_row(texts), 5)
    want = [shingles(t) for t in texts]
    assert s.size.tolist() == [len(x) for x in want]
    assert int(s.distinct.sum()) == len({frozenset(x) for x in want if x})
    assert all((s.fa[i], s.fb[i]) == (s.fa[i + 150], s.fb[i + 150]) for i in range(150))
    assert (s.grams[s.at[7] : s.at[8]] == np.unique(ngram_join.gram_sets(np.frombuffer(texts[7].encode(), dtype=np.uint8), np.array([0, len(texts[7])]), 5)[0])).all()


def test_memory_of_a_chunk():
    """A worker that takes a chunk's sets and first n-grams needs at most ten times the text."""
    rng = random.Random(4)
    texts = [" ".join(rng.choices([f"word{i}" for i in range(3000)], k=500)) for _ in range(600)]
    row = chunk_row(texts)
    ngram_join._Sets(chunk_row(["a b c d e f"]), 5).asked()
    tracemalloc.start()
    s = ngram_join._Sets(row, 5)
    keys = s.asked()
    level = np.packbits(np.concatenate((np.ones(len(keys), dtype=np.uint8), np.zeros(len(keys), dtype=np.uint8)))).tobytes()
    grams, doc = s.first_grams([level], 1, 80)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(grams) and (np.diff(doc) >= 0).all()
    assert peak < 10 * sum(map(len, texts))


def test_small_tables_without_python_workers(spark):
    df = from_rows(spark, [("a", 1), (None, 1 << 40)], "x string, _y long")
    assert df.dtypes == [("x", "string"), ("_y", "bigint")]
    assert [tuple(r) for r in df.collect()] == [("a", 1), (None, 1 << 40)]
    assert "PythonRDD" not in df._jdf.queryExecution().toRdd().toDebugString()
    assert "PythonRDD" in spark.createDataFrame([("a", 1)], "x string, _y long")._jdf.queryExecution().toRdd().toDebugString()
    assert from_rows(spark, [], "x string, _y long").count() == 0
