"""Main text of web pages: site templates are found by counting hashed element subtrees per host and removed.

Pass 1 parses every page, hashes every element subtree that has text and counts, per host, the distinct page contents
that each hash is on (copies of a page count once, wherever they are). Subtrees on many contents of their host are its
template. Pass 2 parses again and deletes template subtrees from the whole page. Only then is it decided, from what is
left, where the text is: in articles, a main part, or all that remains. Furniture that differs from page to page is
known by tag, role and class. Two things keep an article's own words: a recurring subtree that holds most of its
article's (or page's) words stays, and so do the text-bearing blocks of an article, since articles repeat passages.

What is template is decided by a number of pages, whatever the host's size and mix of layouts. A host's list may thus be
long: a page looks up its own hashes in a broadcast of all lists, or, where those are large, gets its own by a join.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import BROADCAST_BYTES, stage

#: A subtree is template when it is on at least this many of a host's distinct page contents. The share is there only for
#: hosts of more than 5,000 contents, where a handful of pages may quote one another.
MIN_PAGES, MIN_SHARE = 5, 0.001
_FLUSH = 200_000

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp noembed noframes".split())
#: Never part of the text.
_DROP = frozenset(
    "head script style template noscript iframe object embed canvas svg math audio video map nav footer aside form button select input textarea label dialog menu "
    "title noembed noframes frameset datalist option".split()
)
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu "
    "nav ol p pre section summary table tbody td tfoot th thead tr ul br".split()
)
#: Text-bearing blocks of an article: repeated ones are the article's own words, never template.
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dd dt blockquote pre table tbody thead tfoot tr td th caption figure figcaption b i em strong a span code br".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_CLOSES_P = _BLOCK - {"br", "body", "html"}
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
#: Words in class, id or role that mark furniture.
_FURNITURE = frozenset(
    "ad ads advert advertisement advertising adverts banner sponsor sponsored promo promotion promoted comment comments commentlist disqus respond replies sidebar sidebars menu menus nav navbar "
    "navigation breadcrumb breadcrumbs footer header masthead cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup share sharing social related "
    "recommended recommendations widget widgets pagination pager skip toolbar search login advertorial outbrain taboola teaser".split()
)
_HOLDS = frozenset("has with without no".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_ATTR = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*([\"']|[^\s>]*))?")
_TAG_END = re.compile(r"[\s/]*>")


class Element:
    __slots__ = ("tag", "attrs", "children", "digest", "has_text", "weight", "gone")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.children, self.digest, self.has_text, self.weight, self.gone = tag, attrs, [], 0, False, 0, False


def parse(text: str) -> Element:
    """A tree of elements and (decoded) strings, in time linear in the text. Unclosed and stray tags are taken as
    browsers mostly take them; a tag that the page breaks off in is dropped, a quote that is never closed is not one."""
    root = Element("#root", {})
    path, at, n = _Path(root), 0, len(text)
    last_quote = {q: text.rfind(q) for q in "\"'"}
    while at < n:
        begin = text.find("<", at)
        if begin < 0:
            _add_text(path[-1], text[at:])
            break
        after = text[begin + 1 : begin + 2]
        closing = after == "/"
        if after in ("!", "?") or closing and not _NAME.match(text, begin + 2) and begin + 2 < n:
            if begin > at:
                _add_text(path[-1], text[at:begin])
            at = _skip_comment(text, begin, n)
            continue
        name = _NAME.match(text, begin + 1 + closing)
        if name is None:  # no tag: a character
            _add_text(path[-1], text[at : begin + 1])
            at = begin + 1
            continue
        if begin > at:
            _add_text(path[-1], text[at:begin])
        attrs, at, empty = _attributes(text, name.end(), n, last_quote)
        if at < 0:
            break
        tag = name[0].lower()
        if closing:
            path.close(tag)
            continue
        if tag in _CLOSES_P:
            path.close("p")
        if tag in _SAME:
            path.end_item(tag)
        e = Element(tag, attrs)
        path[-1].children.append(e)
        if tag in _VOID or (empty and tag not in _BLOCK):
            continue
        if tag in _RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(text, at)
            stop = end.start() if end else n
            e.children.append(text[at:stop])
            close = text.find(">", stop)
            at = n if end is None or close < 0 else close + 1
            continue
        path.push(e)
    return root


def _skip_comment(text: str, begin: int, n: int) -> int:
    """Where the comment, declaration or the like at ``begin`` is over."""
    if text.startswith("<!--", begin):
        if text.startswith(">", begin + 4) or text.startswith("->", begin + 4):
            return text.index(">", begin) + 1
        end = text.find("-->", begin + 4)
        return n if end < 0 else end + 3
    end = text.find(">", begin)
    return n if end < 0 else end + 1


def _attributes(text: str, at: int, n: int, last_quote: dict[str, int]) -> tuple[dict[str, str], int, bool]:
    """The attributes from ``at`` on, where the tag is over (-1: nowhere), and whether it ends in a slash."""
    attrs: dict[str, str] = {}
    while True:
        if end := _TAG_END.match(text, at):
            return attrs, end.end(), end[0].endswith("/>")
        m = _ATTR.match(text, at)
        if m is None or m.end() >= n:
            return attrs, -1, False
        value, at = m[2] or "", m.end()
        if value in ("'", '"') and at <= last_quote[value]:
            end = text.find(value, at)
            value, at = text[at:end], end + 1
        elif value in ("'", '"'):  # never closed
            end = next((k for k in range(at, n) if text[k] in " \t\r\n\f>"), n)
            value, at = value + text[at:end], end
        attrs.setdefault(m[1].lower(), value)


#: An end tag does not reach past these to close something outside.
_WALL = frozenset("article main section div table td th li ul ol body".split())
_REACHES = _WALL | frozenset("nav footer header aside form html head".split())


class _Path(list):
    """The open elements, and where in the path each tag stands."""

    def __init__(self, root: Element) -> None:
        super().__init__([root])
        self._at: dict[str, list[int]] = defaultdict(list)
        self._walls: list[int] = []

    def push(self, e: Element) -> None:
        self._at[e.tag].append(len(self))
        if e.tag in _WALL:
            self._walls.append(len(self))
        self.append(e)

    def _cut(self, k: int) -> None:
        while len(self) > k:
            tag = self.pop().tag
            self._at[tag].pop()
            if tag in _WALL:
                self._walls.pop()

    def _last(self, tags: Iterable[str]) -> int:
        return max((self._at[t][-1] for t in tags if self._at[t]), default=0)

    def close(self, tag: str) -> None:
        k = self._last((tag,))
        if k and (tag in _REACHES or not self._walls or self._walls[-1] < k):
            self._cut(k)

    def end_item(self, tag: str) -> None:
        """A new item ends the one before it in the same list or table."""
        k = self._last(_SAME[tag])
        if k > self._last(_SCOPE[tag]):
            self._cut(k)


def _add_text(parent: Element, text: str) -> None:
    parent.children.append(html.unescape(text) if "&" in text else text)


def is_furniture(e: Element, in_main: bool) -> bool:
    """By kind: tag, role, or a word of class or id."""
    if e.tag in _DROP or "hidden" in e.attrs:
        return True
    if e.tag in ("#root", "html", "body", "main", "article"):
        named = f"{e.attrs.get('class', '')} {e.attrs.get('id', '')}".lower()
        return e.tag == "article" and bool({"comment", "comments", "ad", "advert"} & set(re.split(r"[^a-z]+", named)))
    if e.tag == "header":
        return not in_main
    if not e.attrs:
        return False
    if e.attrs.get("role", "").lower() in _ROLES or "display:none" in e.attrs.get("style", "").replace(" ", "").lower():
        return True
    named = f"{e.attrs.get('class', '')} {e.attrs.get('id', '')}".strip()
    if not named:
        return False
    words = re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", named).lower())
    # "has-sidebar" and the like name what a container holds, not what it is.
    return not _FURNITURE.isdisjoint(words) and _HOLDS.isdisjoint(words)


def _digest(tree: Element) -> None:
    """Sets the hash of every subtree (tags, class, id, role and words) and whether it has text."""
    order, stack = [], [tree]
    while stack:
        e = stack.pop()
        order.append(e)
        stack += [c for c in e.children if not isinstance(c, str)]
    for e in reversed(order):  # children before their parents
        h = xxhash.xxh3_64()
        h.update(e.tag)
        for k in ("class", "id", "role"):
            if v := e.attrs.get(k):
                h.update(f"\0{k}={v}")
        for c in e.children:
            if isinstance(c, str):
                if words := " ".join(c.split()):
                    h.update("\1" + words)
                    e.has_text = True
            else:
                h.update(b"\2" + c.digest.to_bytes(8, "little"))
                e.has_text |= c.has_text
        e.digest = h.intdigest()


def _outermost(tree: Element, tag: str, everywhere: bool = False) -> list[Element]:
    """In page order; unless ``everywhere``, only outside of furniture."""
    found, stack = [], [tree]
    while stack:
        e = stack.pop()
        if e.tag == tag and not is_furniture(e, True):
            found.append(e)
        elif everywhere or e is tree or not is_furniture(e, False):
            stack += [c for c in reversed(e.children) if not isinstance(c, str) and not c.gone]
    return found


def roots(tree: Element) -> tuple[list[Element], bool]:
    """Where the text is: the outermost articles outside of furniture, unless a main part holds more beside them (a card
    among its text); else articles inside furniture (an advert that was never closed may hold the page); else the
    mains; else the whole tree. Weights must be set."""
    articles, mains = _outermost(tree, "article"), _outermost(tree, "main")
    if articles and mains:
        inside = sum(a.weight for m in mains for a in _outermost(m, "article") if a is not m)
        if 2 * inside < sum(m.weight for m in mains):
            return mains, True
    found = articles or _outermost(tree, "article", everywhere=True) or mains
    return (found, True) if found else ([tree], False)


#: Never template themselves.
_FRAME = frozenset("#root html body main article".split())


def candidates(tree: Element) -> set[int]:
    """Hashes of the subtrees that may be template: every one with text, but for an article's text-bearing blocks."""
    _digest(tree)
    out: set[int] = set()
    stack = [(tree, False)]
    while stack:
        e, in_article = stack.pop()
        if not e.has_text or e.tag in _RAW:
            continue
        if e.tag not in _FRAME and not (in_article and e.tag in _PROSE):
            out.add(e.digest)
        in_article |= e.tag in ("article", "main") and not is_furniture(e, True)
        stack += [(c, in_article) for c in e.children if not isinstance(c, str)]
    return out


def _weigh(tree: Element) -> None:
    """Sets the weight of every subtree: its words outside of inner furniture and of what is gone. A script without
    blanks counts by its characters."""
    order, stack = [], [tree]
    while stack:
        e = stack.pop()
        order.append(e)
        stack += [c for c in e.children if not isinstance(c, str) and not c.gone]
    for e in reversed(order):
        e.weight = 0
        for c in e.children:
            if isinstance(c, str):
                words = c.split()
                e.weight += max(len(words), sum(map(len, words)) // 8)
            elif not c.gone and not is_furniture(c, False):
                e.weight += c.weight


def _delete(tree: Element, template: frozenset[int] | set[int]) -> None:
    """Marks the template subtrees. One with more than half of the words of its article, or of a page without, is the
    text itself, met on pages that differ around it: it is kept, and so is all that recurs inside it."""
    stack = [(tree, tree.weight, False)]
    while stack:
        e, whole, in_article = stack.pop()
        for c in e.children:
            if isinstance(c, str):
                continue
            within, weight = in_article, whole
            if c.tag in ("article", "main") and not is_furniture(c, True):
                within, weight = True, c.weight
            elif c.digest in template and c.tag not in _FRAME and not (in_article and c.tag in _PROSE):
                if 2 * c.weight <= whole or is_furniture(c, in_article):
                    c.gone = True
                continue
            stack.append((c, weight, within))


def _headings(top: Element) -> list[Element]:
    """The headings inside an article's own header."""
    found, stack = [], [top]
    while stack:
        e = stack.pop()
        if e.tag in _HEADING:
            found.append(e)
        elif not e.gone and (e is top or not is_furniture(e, True)):
            stack += [c for c in reversed(e.children) if not isinstance(c, str)]
    return found


def main_text(tree: Element, template: frozenset[int] | set[int]) -> str:
    """The blocks that remain, in page order, white space folded, joined by one space."""
    blocks: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if words := "".join(run).split():
            blocks.append(" ".join(words))
        run.clear()

    _weigh(tree)
    if template:
        _delete(tree, template)
        _weigh(tree)
    tops, in_main = roots(tree)
    for top in tops:
        stack: list = [top]
        while stack:
            e = stack.pop()
            if e is None:
                flush()
            elif isinstance(e, str):
                run.append(e)
            elif e.gone or (e is not top and is_furniture(e, in_main)):
                flush()
            elif e.tag == "header" and in_main:
                stack += [None, *reversed(_headings(e)), None]
            elif e.tag in _BLOCK or e is top:
                stack += [None, *reversed(e.children), None]
            else:
                stack += list(reversed(e.children))
        flush()
    return " ".join(blocks)


def host_of(url: str | None) -> str:
    """The host in lower case; empty where there is none."""
    m = re.match(r"\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#\s]*)", url or "")
    return m[1].rpartition("@")[2].lower() if m else ""


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``host, digest, content``: which subtrees are on which page contents, each once until the set is sent."""
    seen: set[tuple[str, int, int]] = set()

    def flush() -> pa.RecordBatch:
        hosts, digests, contents = zip(*seen, strict=True)
        seen.clear()
        return pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), *(pa.array(np.array(a, dtype=np.uint64).view(np.int64)) for a in (digests, contents))], names=["host", "digest", "content"])

    for batch in batches:
        for url, page in zip(batch.column(0), batch.column(1), strict=True):
            host = host_of(url.as_py())
            tree = parse(page.as_py() or "")
            content = xxhash.xxh3_64_intdigest(main_text(tree, frozenset()))
            seen.add((host, 0, content))  # digest 0 counts the host's contents
            seen.update((host, d, content) for d in candidates(tree))
            if len(seen) > _FLUSH:
                yield flush()
    if seen:
        yield flush()


def templates(df: DataFrame, url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """``host, digest``: the hashes of the subtrees that recur across each host's distinct page contents."""
    contents = df.select(F.col(url_col).cast("string"), html_col).mapInArrow(_contents, "host string, digest long, content long").distinct()
    counts = stage(contents.groupBy("host", "digest").agg(F.count("*").alias("pages")), "templates")
    hosts = stage(counts.where("digest = 0").select("host", F.col("pages").alias("of")), "hosts")
    often = counts.where((F.col("digest") != 0) & (F.col("pages") >= min_pages)).join(hosts, "host").where(F.col("pages") >= min_share * F.col("of"))
    return stage(often.select("host", "digest"), "template")


def _page_key(url: str | None, page: str | None) -> str:
    return hashlib.sha256(f"{url or ''}\0{page or ''}".encode()).hexdigest()


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``page, host, digest``: the subtrees that each page would like to know about."""
    for batch in batches:
        for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if digests := candidates(parse(page or "")):
                n = len(digests)
                yield pa.RecordBatch.from_arrays([pa.array([_page_key(url, page)] * n), pa.array([host_of(url)] * n), pa.array(np.fromiter(digests, np.uint64, n).view(np.int64))], names=["page", "host", "digest"])


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``<id_col>, <url_col>, main_text`` of every row; null html gives the empty text.

    Repeated rows are extracted alike and count once as pages of the host; a null url belongs to the empty host. Long
    pages are read whole, in time linear in their length; an empty table gives no rows. A subtree on exactly the least
    number of pages is template. Extra columns are ignored. The lists of all hosts are broadcast when their measured bytes are small; else each page's
    hashes are joined with them by host and hash, so that no row carries more than its own.
    """
    found = templates(df, url_col, html_col)
    size = found.agg(F.sum(F.octet_length("host") + 8)).first()[0] or 0
    pages = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), F.col(url_col).cast("string").alias("_url"))
    if size > BROADCAST_BYTES:
        return _extract_joined(pages, found).select(F.col("id").alias(id_col), F.col("url").alias(url_col), "main_text")

    rows = found.toArrow().sort_by([("host", "ascending")])
    hosts, digests = rows.column("host").to_pylist(), rows.column("digest").to_numpy().view(np.uint64)
    cuts = [k for k in range(len(hosts)) if k == 0 or hosts[k] != hosts[k - 1]]
    lists = {hosts[k]: np.sort(digests[k:end]) for k, end in zip(cuts, [*cuts[1:], len(hosts)], strict=False)}
    sent = df.sparkSession.sparkContext.broadcast(lists)

    @F.pandas_udf("string")
    def text(html_of: pd.Series, url_of: pd.Series) -> pd.Series:
        out = []
        for page, url in zip(html_of, url_of, strict=True):
            tree, known = parse(page or ""), set()
            of_host = sent.value.get(host_of(url))
            if of_host is not None and (asked := candidates(tree)):
                keys = np.fromiter(asked, np.uint64, len(asked))
                at = np.minimum(np.searchsorted(of_host, keys), len(of_host) - 1)
                known = set(keys[of_host[at] == keys].tolist())
            out.append(main_text(tree, known))
        return pd.Series(out, dtype=object)

    return pages.select(F.col("id").alias(id_col), F.col("url").alias(url_col), text("html", "_url").alias("main_text"))


def _extract_joined(pages: DataFrame, found: DataFrame) -> DataFrame:
    """``id, url, main_text`` with each page's template hashes brought to it by joins, which Spark splits where hot."""
    asked = pages.select("_url", "html").mapInArrow(_asked, "page string, host string, digest long").distinct()
    known = asked.join(found, ["host", "digest"]).groupBy("page").agg(F.collect_list("digest").alias("template"))
    key = F.sha2(F.concat(F.coalesce("_url", F.lit("")), F.lit("\0"), F.coalesce("html", F.lit(""))), 256)

    @F.pandas_udf("string")
    def text(html_of: pd.Series, template: pd.Series) -> pd.Series:
        out = []
        for page, hashes in zip(html_of, template, strict=True):
            tree, digests = parse(page or ""), set()
            if hashes is not None:
                _digest(tree)
                digests = {int(h) & 0xFFFFFFFFFFFFFFFF for h in hashes}
            out.append(main_text(tree, digests))
        return pd.Series(out, dtype=object)

    return pages.withColumn("page", key).join(known, "page", "left").select("id", "url", text("html", "template").alias("main_text"))
