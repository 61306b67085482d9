"""Extraction, sharding, mixing and the pipeline."""

import collections
import math
import random
import time
import zlib

import pytest
from hypothesis import given, settings, strategies as st

import corpus_pipeline
from veilspark.llm import exact_dedup, html_extract, mixing, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PAGES = "page_id long, url string, html string"


def text_of(page, template=frozenset()):
    tree = html_extract.parse(page)
    html_extract._digest(tree)
    return html_extract.main_text(tree, template)


@pytest.mark.parametrize(
    "page,want",
    [
        ("", ""),
        ("<p>a<p>b &amp; c&nbsp;d", "a b & c d"),
        ("<html><head><title>t</title></head><body><nav>n</nav><article><h1>T</h1><p>one\n two<br>three <b>bo</b>ld</article><footer>f</footer>", "T one two three bold"),
        ("<div class='ad'>x<article>in<p>side</article></div>", "in side"),
        ("<article><p>a</p><aside>s</aside><div class=comments><p>c</div><form>q<input></form><p>b</article>", "a b"),
        ("<script>var t='</p>';</script><style>p{}</style><p>x</p><!-- c --><p>y", "x y"),
        ("<main><header><h1>H</h1><p>by</p></header><p>t</main><header>site</header>", "H t"),
        ("<main><article><p>a</article><p>next</main><aside><article>teaser</article></aside>", "a"),
        ("<div class='with-sidebar'><p>text</div><div class='sidebar'>s</div>", "text"),
        ("a < b and 3 > 2", "a < b and 3 > 2"),
        ("<ul><li>x<li>y</ul><table><tr><td>1<td>2</table>", "x y 1 2"),
        ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
        ("<div hidden>no</div><p>yes<span hidden=''>no</span>", "yes"),
        ("<p title=don't>Hello world, it's fine</p><p>rest</p>", "Hello world, it's fine rest"),
        ("<main><h1>T</h1><p>one two three</p><article>card</article><p>tail of it</main>", "T one two three card tail of it"),
        ("<article><header><div><h1>Head</h1></div><p>by</p></header><p>t</article>", "Head t"),
        ("a</>b</ c>d<!-->e<!-- f --><?g?>h<!i>j", "abdehj"),
        ("<p>a<p title='never closed>b</p><p>c", "a b c"),
        ("<p>a<p clas", "a"),
        ("x" * 3_000_000 + "<p>" + "y " * 1_000_000, "x" * 3_000_000 + " " + " ".join("y" * 1_000_000)),
    ],
)
def test_main_text(page, want):
    assert text_of(page) == want


@pytest.mark.parametrize("piece", ['<p title="x>text ', "<a b='c ", "<p a=\"'", "</p><b>", "<!-- ", "<b <i ", "<li>", "<td><b>"])
def test_parsing_is_linear(piece):
    took = []
    for n in (4_000, 32_000):
        began = time.perf_counter()
        text_of(piece * n)
        took.append(time.perf_counter() - began)
    assert took[1] < 30 * took[0] + 0.5


def plain_text(host, pages_of_host):
    """The texts of one host's pages (trees of [tag, *children]) by the definition, a subtree at a time."""
    frame, block, prose, drop = {"body", "article"}, {"body", "article", "div", "p"}, {"p", "span"}, {"nav"}
    has_text = lambda x: any(isinstance(c, str) or has_text(c) for c in x[1:])
    words = lambda x: sum(len(c.split()) if isinstance(c, str) else words(c) if c[0] not in drop else 0 for c in x[1:])

    def under(x, inside=False):
        if x[0] not in frame and not (inside and x[0] in prose) and has_text(x):
            yield repr(x)
        for c in x[1:]:
            if not isinstance(c, str):
                yield from under(c, inside or x[0] == "article")

    def without(x, template, whole, inside):
        out = [x[0]]
        for c in x[1:]:
            if isinstance(c, str):
                out.append(c)
            elif c[0] == "article":
                out.append(without(c, template, words(c), True))
            elif c[0] != "body" and repr(c) in template and not (inside and c[0] in prose):
                if 2 * words(c) > whole and c[0] not in drop:
                    out.append(c)
            else:
                out.append(without(c, template, whole, inside or x[0] == "article"))
        return out

    def blocks(x):
        if x[0] in drop:
            return "\0"
        text = "".join(c if isinstance(c, str) else blocks(c) for c in x[1:])
        return f"\0{text}\0" if x[0] in block else text

    def articles(x):
        return [x] if x[0] == "article" else [a for c in x[1:] if not isinstance(c, str) and c[0] not in drop for a in articles(c)]

    def text(x):
        parts = [" ".join(b.split()) for a in articles(x) or [x] for b in blocks(a).split("\0")]
        return " ".join(b for b in parts if b)

    on = collections.defaultdict(set)
    for page in pages_of_host:
        for k in under(page):
            on[k].add(text(page))
    template = {k for k, contents in on.items() if len(contents) >= 5}
    return [text(without(page, template, words(page), False)) for page in pages_of_host], template


def test_templates_against_plain(spark):
    rnd = random.Random(12)
    render = lambda x: f"<{x[0]}>{''.join(c if isinstance(c, str) else render(c) for c in x[1:])}</{x[0]}>"
    shared = [["div", "follow us"], ["div", ["p", "sign up"], "now "], ["p", "terms apply"], ["nav", ["span", "home"]], ["div", ["span", "a"], ["div", "b c"]], ["div", "x " * 40]]
    own = lambda i: rnd.choice((["p", f"text {i} {rnd.random()}"], ["div", ["p", f"more {rnd.random()} words"], rnd.choice(shared)], ["span", f"s{i} "], ["div", f"d {i % 3}"]))
    pages = []
    for i in range(90):
        body = [rnd.choice((own(i), rnd.choice(shared))) for _ in range(rnd.randint(1, 7))]
        if rnd.random() < 0.5:
            body.insert(rnd.randrange(len(body) + 1), ["article", *(rnd.choice((own(i), rnd.choice(shared))) for _ in range(rnd.randint(1, 5)))])
        pages.append((f"h{i % 3}.example", ["body", *body]))
    pages += pages[:20]  # copies count once
    want, found = {}, 0
    for host in ("h0.example", "h1.example", "h2.example"):
        at = [k for k, p in enumerate(pages) if p[0] == host]
        texts, template = plain_text(host, [pages[k][1] for k in at])
        want |= dict(zip(at, texts, strict=True))
        found += len(template)
    df = spark.createDataFrame([(k, f"http://{host}/{k}", render(page)) for k, (host, page) in enumerate(pages)], PAGES).repartition(3)
    assert {r["page_id"]: r["main_text"] for r in html_extract.extract(df).collect()} == want
    assert html_extract.templates(df).count() == found > 10


def test_furniture_without_names(spark):
    """No article, no telling tag or class: what recurs on the host goes by its hash alone."""
    furniture = "<div><ul><li>Home<li>News<li>Shop</ul></div><div><p>Buy two, get one</p></div><div><span>We use crumbs</span> <b>Fine</b></div>"
    rows = [(i, f"http://s.example/{i}", f"<html><body>{furniture}<div><h1>Title {i}</h1><p>story {i} is told here</p></div><div>All rights kept</div></body></html>") for i in range(12)]
    got = {r["page_id"]: r["main_text"] for r in html_extract.extract(spark.createDataFrame(rows, PAGES).repartition(3)).collect()}
    assert got == {i: f"Title {i} story {i} is told here" for i in range(12)}
    # on four pages only: no template yet
    few = {r["main_text"] for r in html_extract.extract(spark.createDataFrame(rows[:4], PAGES)).collect()}
    assert all(t.startswith("Home News Shop") for t in few)
    # beside an article the rest of the page is counted too
    rows = [(i, "http://s.example/", f"<body>{furniture}<article><p>story {i}</article></body>") for i in range(6)]
    assert html_extract.templates(spark.createDataFrame(rows, PAGES)).count() > 5


def test_templates(spark):
    page = lambda i: f"<body><div><p>Read our papers</p></div><div><p>own words {i}</p></div></body>"
    rows = [(i, "http://a.example/x", page(i)) for i in range(8)] + [(100, "http://b.example/", page(100)), (101, None, None), (102, "http://a.example/y", "")]
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "page_id long, url string, html string, pages long, template string").repartition(3)
    got = {r["page_id"]: r["main_text"] for r in html_extract.extract(df).collect()}
    assert got[3] == "own words 3" and got[100] == "Read our papers own words 100" and got[101] == got[102] == ""
    # an article's own paragraphs are kept however often they recur
    df = spark.createDataFrame([(i, "http://a.example/", "<article><p>same text</p></article>") for i in range(9)], "page_id long, url string, html string")
    assert {r["main_text"] for r in html_extract.extract(df).collect()} == {"same text"}
    assert html_extract.extract(df.limit(0)).collect() == []


def test_copies_are_no_template(spark):
    same = "the same five hundred words over and over"
    for wrap in ("<article><div class=body><p>{}</p></div></article>", "<body><div><p>{}</p></div></body>", "<body><p>{}</p></body>"):
        rows = [(i, "http://a.example/", wrap.format(same if i < 6 else f"page {i} has text of its own")) for i in range(18)]
        got = {r["page_id"]: r["main_text"] for r in html_extract.extract(spark.createDataFrame(rows, PAGES).repartition(3)).collect()}
        assert {got[i] for i in range(6)} == {same} and got[9] == "page 9 has text of its own"
    # an article that recurs whole, in sections, with another date each time; a small notice outside of it goes
    body = "<div class=body><section>first part of it</section><section>second part of it</section><section>third part of it</section></div>"
    rows = [(i, "http://a.example/", f"<article><div>day {i}</div>{body}<div>tell a friend</div></article>") for i in range(9)]
    got = {r["page_id"]: r["main_text"] for r in html_extract.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {i: f"day {i} first part of it second part of it third part of it" for i in range(9)}


def test_template_of_few_pages(spark, monkeypatch):
    # four layouts of a quarter each, a promotion on a tenth of the pages, and one host where all pages are alike
    layout = lambda i: f"<div>layout {i % 4}</div>" + ("<div>buy now</div>" if i % 10 == 0 else "")
    page = lambda i: f"<body>{layout(i)}<article><section>see {i % 4}</section><p>page {i} has text of its own</p></article></body>"
    bare = lambda i: f"<body>{layout(i)}<div>page {i} has text of its own</div></body>"
    rows = [(i, "http://a.example/", page(i)) for i in range(60)] + [(i, "http://user@B.example/", bare(i)) for i in range(60, 120)] + [(120, None, None), (121, "http://a.example/", None)]
    want = {i: f"page {i} has text of its own" for i in range(120)} | {120: "", 121: ""}
    df = spark.createDataFrame(rows, PAGES).repartition(3)
    assert {r["page_id"]: r["main_text"] for r in html_extract.extract(df).collect()} == want
    monkeypatch.setattr(html_extract, "BROADCAST_BYTES", 0)  # lists too large for a broadcast
    got = html_extract.extract(df.union(df)).collect()
    assert len(got) == 244 and {r["page_id"]: r["main_text"] for r in got} == want


def plain_best_fit(sizes, capacity):
    room, out = [], []
    for s in sizes:
        fits = [(r, i) for i, r in enumerate(room) if r >= s]
        if fits:
            i = min(fits)[1]
        else:
            i = len(room)
            room.append(max(capacity, s))
        room[i] -= s
        out.append(i)
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60), st.integers(5, 40))
def test_best_fit_decreasing(sizes, capacity):
    sizes = sorted(sizes, reverse=True)
    classes = sorted(collections.Counter(sizes).items(), reverse=True)
    got = [b for n, b in sharding.best_fit_decreasing(classes, capacity) for _ in range(n)]
    assert got == plain_best_fit(sizes, capacity)


@pytest.mark.parametrize("large,most,least", [({60_000: 10}, 120_000, 92_000), ({55_000: 9}, 110_000, 82_000), ({300_000: 1, 60_000: 9}, 300_000, 98_000), ({}, 24_325, 24_325)])
def test_fit_into_with_large_groups(large, most, least):
    classes = sorted((large | {s: 20 for s in range(1, 140)}).items(), reverse=True)
    sizes = [s for s, n in classes for _ in range(n)]
    bins = [b for n, b in sharding.fit_into(classes, 8) for _ in range(n)]
    load = collections.Counter()
    for s, b in zip(sizes, bins, strict=True):
        load[b] += s
    # groups of over half a share sit in twos where they must, and the others share evenly what is left
    assert set(load) == set(range(8)) and max(load.values()) == most and min(load.values()) >= least


def _docs(n=400, seed=3):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        t = " ".join(rnd.choice("alpha beta gamma delta".split()) for _ in range(rnd.randint(0, 60)))
        rows.append((i, rows[rnd.randrange(i)][1] if i and rnd.random() < 0.2 else t, "en", rnd.choice(("s1", "s1", "s1", "s2", "s3", None)), len(t)))
    return rows + [(None, None, None, None, None), (n, "", "en", "s2", 0), (n + 1, "é " * 3, "en", "s2", 6), (5, rows[5][1], "en", "s1", 0), (5, rows[5][1], "en", "s1", 0)]


def test_pack(spark):
    rows = _docs()
    got = sharding.pack(spark.createDataFrame(rows, SCHEMA).repartition(3), shards=8).collect()
    assert len(got) == len(rows)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert set(slots) == set(range(8)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    size = collections.Counter()
    for r in got:
        size[r["shard"]] += r["size"]
    largest = max(collections.Counter(r[1] for r in rows).items(), key=lambda kv: kv[1] * (len((kv[0] or "").encode()) + 1))
    assert max(size.values()) - min(size.values()) <= largest[1] * (len((largest[0] or "").encode()) + 1)
    shard_of = {}
    want = collections.Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert want == collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got)
    text = {r[0]: r[1] for r in rows}
    for r in got:
        assert shard_of.setdefault(text[r["doc_id"]], r["shard"]) == r["shard"]
    few = sharding.pack(spark.createDataFrame(rows, SCHEMA), shards=None, capacity=5000).groupBy("shard").sum("size").collect()
    assert max(r[1] for r in few) <= 5000
    assert sharding.pack(spark.createDataFrame([], SCHEMA)).collect() == []


def test_pack_sizes_are_exact(spark):
    # 100,001 and 31,071 fill a capacity of 131,072 to the byte; columns that clash with the operator's own
    schema = "doc_id long, text string, rank string, key int, shard string, bytes int"
    df = spark.createDataFrame([(1, "a" * 100_000, "r", 1, "s", 2), (2, "b" * 31_070, "r", 1, "s", 2)], schema)
    got = sharding.pack(df, shards=None, capacity=131_072).collect()
    assert {(r["doc_id"], r["size"], r["shard"]) for r in got} == {(1, 100_001, 0), (2, 31_071, 0)}
    assert {r["shard"] for r in sharding.pack(df, shards=None, capacity=131_071).collect()} == {0, 1}
    # groups of one size, more than a bin holds: every one whole, ties by hash
    rows = [(i, f"{i % 40:03d}" * 30_000) for i in range(80)]
    got = sharding.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), shards=8).collect()
    load = collections.Counter(r["shard"] for r in got)
    assert set(load.values()) == {10} and all(r["shard"] == s["shard"] for r in got for s in got if (r["doc_id"] - s["doc_id"]) % 40 == 0)


def test_targets(spark):
    sizes = {"a": 1000, "b": 10, "c": 500, None: 200}
    df = spark.createDataFrame([(k, float(v)) for k, v in sizes.items()], "source string, source_size double")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    weight = {"a": 1, "b": 2, "c": 3, None: 1}
    target, open_ = dict.fromkeys(sizes, 0.0), set(sizes)
    left = float(sum(sizes.values()))
    while True:  # share, stop what is above, share the rest again
        w = sum(weight[k] for k in open_)
        above = {k for k in open_ if left * weight[k] / w > 3 * sizes[k]}
        if not above:
            break
        for k in above:
            target[k] = 3.0 * sizes[k]
        open_ -= above
        left = sum(sizes.values()) - sum(target[k] for k in sizes if k not in open_)
    for k in open_:
        target[k] = left * weight[k] / sum(weight[j] for j in open_)
    assert got == pytest.approx(target)


def test_mix(spark):
    rows = _docs()
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(df.repartition(3)).collect()
    again = mixing.mix(df.repartition(5)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    size = lambda t: len((t or "").encode().split())
    assert collections.Counter((r[0], size(r[1])) for r in rows) == collections.Counter((r["doc_id"], r["size"]) for r in got)
    taken, target = collections.Counter(), {}
    for r in got:
        assert r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    for s, t in target.items():
        assert abs(taken[s] - t) <= 62, (s, taken[s], t)
    mixed = mixing.mixed(df)
    assert mixed.columns == df.columns
    assert sum(size(r["text"]) for r in mixed.collect()) == sum(taken.values())
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).collect() == []


def test_rates_against_plain(spark):
    """Each source's rates are min(3, exp(multiplier * size / mean)), the multiplier found here by plain bisection."""
    got = mixing.mix(spark.createDataFrame(_docs(500, 9), SCHEMA).repartition(4)).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["source"]].append(r)
    for rows in by.values():
        sizes, target = [r["size"] for r in rows], rows[0]["target"]
        mean = sum(sizes) / len(sizes)
        rate = lambda lam, s: min(3.0, math.exp(min(50.0, lam * s / mean)))
        lo, hi = -500.0, 500.0
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if sum(s * rate(mid, s) for s in sizes) < target else (lo, mid)
        for r in rows:
            if r["size"]:
                want = 3.0 if target >= 3 * sum(sizes) else rate(lo, r["size"])
                assert r["rate"] == pytest.approx(want, rel=1e-4, abs=1e-6) and abs(r["copies"] - r["rate"]) < 1 + 1e-6
        assert abs(sum(r["taken"] for r in rows) - target) <= max(sizes)


def test_mix_of_many_sources_and_extremes(spark):
    rows = [(i, "w " * (1 + i % 7), "en", f"s{i // 3:04d}", 0) for i in range(900)]
    rows += [(2000, "long " * 200_000, "en", "s0001", 0), (2001, "w", "en", "s9", 0), (2002, "w", "en", "s9", 0)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    taken, target, largest = collections.Counter(), {}, collections.Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert len(target) == 301 and all(abs(taken[s] - t) <= largest[s] for s, t in target.items())


def test_clashing_names_and_repeated_ids(spark):
    schema = "doc_id long, text string, source string, rank int, bucket int, rate int, size int, _words int, _k int, _copies int, _copy int, _sha int, _chars2 int, _rn int, _id int"
    rows = [(i // 2, f"{'a b' if i % 3 else 'a  b'} {i % 5}", "s", *range(i, i + 12)) for i in range(40)] + [(None, None, None, *[None] * 12)] * 2
    df = spark.createDataFrame(rows, schema)
    for make in (mixing.mixed, exact_dedup.drop_exact_duplicates):
        first, again = make(df.repartition(3)), make(df.repartition(7))
        assert first.columns == df.columns
        got = sorted(map(repr, first.collect()))
        assert got == sorted(map(repr, again.collect())) and set(got) <= set(map(repr, df.collect()))
    kept = exact_dedup.drop_exact_duplicates(df).collect()
    normal = lambda t: "".join((t or "").split())
    assert sorted(normal(r["text"]) for r in kept) == sorted({normal(r[1]) for r in rows})


def test_pipeline(spark, tmp_path):
    rows = [(i, f"{t} some more words of document {i // 2} here" if t else t, lang, s, n) for i, (_, t, lang, s, n) in enumerate(_docs(60))] + [(900, "12 34 !!", "en", "s1", 8)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            seen.append({r["doc_id"] for r in docs.collect()})
    letters = {r[0] for r in rows if any(c.isalpha() for c in r[1] or "")}
    assert seen[0] == letters
    texts = {r[0]: "".join((r[1] or "").split()) for r in rows}
    assert len(seen[1]) == len({texts[i] for i in letters})
    assert seen[2] <= seen[1] and seen[3] <= seen[2]
    assert docs.count() == corpus_pipeline.run(spark, str(tmp_path)).count() > 0
