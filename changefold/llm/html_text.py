"""Main text of web pages by nearest-URL page differencing.

Pages of one host, sorted by URL path, are paired with their neighbours: a
page and the next one in that order, and an odd last page with the pair before
it. The text lines of two paired pages are aligned by longest common
subsequence; shared lines are the site's template and are deleted. Markup that
says what a line is comes first: menus, headers, footers, asides, notices,
adverts, forms, scripts and comments go on every page, and lines inside the
page's own article or main element are not deleted for being shared, because
two pages may publish one article. Differencing decides about the lines that
the markup leaves open, on every page: those beside an article stay, unless
they are shared.
"""

from __future__ import annotations

import html as entities
import itertools
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from changefold.llm.common import contiguous, partitions
from changefold.session import materialize

#: Fixed: HTML elements by role.
DROPPED = frozenset("nav header footer aside form head button select dialog menu".split())
MAIN = frozenset("article main".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split()
)
#: Fixed: whole class, id and role tokens that name what is not the article,
#: and the compounds of them that name the same; other compounds (has-sidebar,
#: page-with-nav, search-result, entry-header) say something of a page's body.
BOILER = re.compile(
    r"ads?|advert\w*|sponsor\w*|promo\w*|banner|cookie\w*|consent|notice|gdpr|popup|modal|newsletter|subscribe|"
    r"nav|navbar|navigation|menu|breadcrumbs?|header|masthead|footer|foot|sidebar|side|aside|widget|related|share|sharing|social|"
    r"comments?|commentlist|respond|replies|reply|disqus|pagination|pager|complementary|contentinfo|search|"
    r"(?:ads?|advert\w*|sponsor\w*|promo\w*)[-_](?:slot|unit|box|block|banner|container|wrapper|area|space|label|links?|\d+)|"
    r"(?:cookie|consent|gdpr|privacy)[-_](?:notice|banner|bar|consent|popup|message|overlay)|"
    r"(?:site|main|global|top|primary|secondary|bottom|mobile|sub)[-_](?:nav|navbar|navigation|menu|header|footer|sidebar|banner)|"
    r"(?:nav|navbar|navigation|menu|footer|header|sidebar|widget)[-_](?:menu|links?|list|items?|bar|area|inner|top|bottom|left|right|nav|widgets?)|"
    r"(?:related|share|sharing|social|comments?|reply)[-_](?:posts?|articles?|stories|content|links?|list|items?|buttons?|bar|icons?|form|area|section|wrapper|container|box|body|respond)|"
    r"(?:post|posts|entry|article|page)[-_](?:navigation|nav|pagination|share|sharing|related|comments?|footer)|"
    r"search[-_](?:form|box|bar|field|input|button|toggle)|"
    r"(?:newsletter|subscribe|breadcrumbs?|pagination|pager|popup|modal|notice)[-_](?:signup|form|box|bar|banner|nav|list|links?|trail|container|wrapper|dialog|overlay|item)|"
    r"(?:nav|navbar|menu|footer|sidebar|breadcrumbs?|pagination|share|social|comments?|cookie|modal|popup)(?:__|--)[\w-]+",
    re.I,
)
#: Fixed: those whose members are article elements of their own.
LISTS = re.compile(r"(?:related|comments?|commentlist|respond|replies|reply|disqus)(?:[-_].*)?|(?:post|posts|entry|article|page)[-_](?:related|comments?)", re.I)
_OPENER = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|(/?)([a-zA-Z][^\s/>]*))")
_QUOTE = re.compile(r"[>\"']")
#: Fixed: elements whose content is no markup.
RAW = {name: re.compile(rf"</{name}\s*>", re.I) for name in "script style noscript template svg iframe textarea title".split()}
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

#: Fixed: tokens that name the body itself, and those that beside one of them say nothing.
BODY = re.compile(r"(?:main|page|post|entry|article|story)?[-_]?(?:content|body|text)|article|story|main", re.I)
MILD = re.compile(r"share|sharing|social|search|widget|side|banner|promo|header|notice", re.I)

OPEN, KEPT = 0, 1
SLICE = 256
#: What makes an element boilerplate, the stronger the higher.
FREE, NAMED, LISTED, ELEMENT = range(4)


def _tags(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, closing, name, attributes) of each piece of markup in order;
    comments, declarations and elements without markup inside have no name.

    Each piece is consumed when found, and where the rest of the page has no
    such mark a search is not made again, so the time is linear in the page.
    A quote that nothing closes does not count, nor do quotes in which all that
    follows would vanish; a tag that no ``>`` ends is text."""
    at, missing, quoted = 0, set(), True

    def find(mark: str, start: int) -> int:
        if mark in missing:
            return -1
        found = page.find(mark, start)
        if found < 0:
            missing.add(mark)
        return found

    def tag_end(start: int) -> int:
        while True:
            m = _QUOTE.search(page, start)
            if m is None:
                return -1
            if m[0] == ">":
                return m.end()
            close = find(m[0], m.end())
            start = m.end() if close < 0 else close + 1

    while m := _OPENER.search(page, at):
        head, name = m[0], (m[2] or "").lower()
        if head == "<!--" or head == "<![CDATA[":
            mark = "-->" if head == "<!--" else "]]>"
            end = find(mark, m.end())
            at = len(page) if end < 0 else end + len(mark)
            yield m.start(), at, False, "", ""
            continue
        end = find(">", m.end()) + 1
        if not end:
            return
        if name and quoted:
            closed = tag_end(m.end())
            quoted = closed >= 0  # else quotes swallow the rest: from here on they do not count
            end = closed if quoted else end
        attributes = page[m.end() : end - 1] if name else ""
        at = end
        if name in RAW and not m[1]:
            close = None if f"</{name}" in missing else RAW[name].search(page, end)
            if close is None:
                missing.add(f"</{name}")
            at, name = (len(page) if close is None else close.end()), ""
        yield m.start(), at, bool(m[1]), name, attributes


def _boiler(name: str, named: str, inside: bool) -> int:
    """What an element is; ``inside`` an article, a header is the article's own."""
    if name == "form":
        return ELEMENT if inside else NAMED  # a form around the whole page holds the article too
    if name in DROPPED:
        return FREE if name == "header" and inside else ELEMENT
    if not named or name in MAIN or name in ("html", "body"):
        return FREE
    tokens = named.split()
    body = any(BODY.fullmatch(t) for t in tokens)
    found = [t for t in tokens if BOILER.fullmatch(t) and not (body and MILD.fullmatch(t))]
    return LISTED if any(LISTS.fullmatch(t) for t in found) else NAMED if found else FREE


def lines(page: str) -> list[tuple[int, str]]:
    """(role, text) of each block with text, markup gone, what markup calls
    boilerplate left out; role KEPT inside an article or main element. Such an
    element ends boilerplate that only class and id names around it say, or a
    form around it, but for an article in an article or in a list of comments
    or related ones."""
    out: list[tuple[int, str]] = []
    held: list[str] = []
    stack: list[tuple[str, int, bool]] = []  # element, boilerplate from here on, inside the article
    depth: Counter[str] = Counter()  # of each element in the stack

    def close_block() -> None:
        text = " ".join(entities.unescape("".join(held)).split())
        held.clear()
        if text:
            out.append((KEPT if stack and stack[-1][2] else OPEN, text))

    def cut(i: int) -> None:
        depth.subtract(s[0] for s in stack[i:])
        del stack[i:]

    at = 0
    for start, end, closing, name, attributes in _tags(page):
        if start > at and not (stack and stack[-1][1]):
            held.append(page[at:start])
        at = end
        if not name:
            continue
        inline = name in INLINE
        if closing:
            if not inline:
                close_block()
            for i in range(len(stack) - 1, -1, -1) if depth[name] else ():
                if inline and stack[i][0] not in INLINE:
                    break  # a stray end tag does not close blocks
                if stack[i][0] == name:
                    cut(i)
                    break
            continue
        if name in VOID:
            if not inline:
                close_block()
            continue
        named = " ".join(a or b or c for a, b, c in _NAMED.findall(attributes)) if attributes else ""
        above, inside = (stack[-1][1], stack[-1][2]) if stack else (FREE, False)
        own = _boiler(name, named, inside)
        if above == NAMED and (name == "main" or name == "article" and all(s[0] != "article" for s in stack)):
            above = FREE
        boiler = max(above, own)
        if name == "p" or not inline:
            close_block()
        if name in ("p", "li", "tr", "td", "th", "option", "dd", "dt"):  # their end tags are optional
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    boiler = boiler if not stack[i][1] else max(stack[i - 1][1] if i else FREE, own)
                    cut(i)
                    break
                if stack[i][0] not in INLINE and stack[i][0] != "p":
                    break
        if attributes.rstrip().endswith("/"):
            continue
        depth[name] += 1
        stack.append((name, boiler, (stack[-1][2] if stack else False) or (name in MAIN and not boiler)))
    if at < len(page) and not (stack and stack[-1][1]):
        held.append(page[at:])
    close_block()
    return out


def shared(a: list[str], b: list[str]) -> tuple[set[int], set[int]]:
    """Lines of ``a`` and of ``b`` in a longest common subsequence (Hunt and
    Szymanski, between the common start and the common end)."""
    start, end, least = 0, 0, min(len(a), len(b))
    while start < least and a[start] == b[start]:
        start += 1
    while end < least - start and a[-1 - end] == b[-1 - end]:
        end += 1
    x = {*range(start), *range(len(a) - end, len(a))}
    y = {*range(start), *range(len(b) - end, len(b))}
    places: dict[str, list[int]] = {}
    for j in range(len(b) - end - 1, start - 1, -1):
        places.setdefault(b[j], []).append(j)
    ends: list[int] = []  # least last line of b of a subsequence of each length
    chains: list[tuple] = []  # that subsequence from its end
    for i in range(start, len(a) - end):
        for j in places.get(a[i], ()):
            k = bisect_left(ends, j)
            chain = (i, j, chains[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                chains.append(chain)
            else:
                ends[k], chains[k] = j, chain
    chain = chains[-1] if chains else None
    while chain:
        x.add(chain[0])
        y.add(chain[1])
        chain = chain[2]
    return x, y


def _ranks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Place of each row in its host within this sorted partition."""
    from pyspark import TaskContext

    part, last, n = TaskContext.get().partitionId(), object(), 0
    for frame in frames:
        places = []
        for host in frame["host"]:
            n = n + 1 if host == last else 0
            last = host
            places.append(n)
        yield frame.assign(part=part, place=places)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All lines with their number among the open ones (-1: an article's), and
    a hash of the article's (null: none); ``SLICE`` pages are held as text."""
    for whole in batches:
        for at in range(0, whole.num_rows, SLICE):
            batch = whole.slice(at, SLICE)
            texts, numbers, digests = [], [], []
            for page in batch.column("html"):
                own = lines(page.as_py() or "")
                texts.append([t for _, t in own])
                count = itertools.count()
                numbers.append([next(count) if role == OPEN else -1 for role, _ in own])
                article = "\n".join(t for role, t in own if role == KEPT)
                digests.append(blake2b(article.encode("utf-8", "replace"), digest_size=8).digest() if article else None)
            made = [
                pa.array(texts, pa.list_(pa.string())), pa.array(numbers, pa.list_(pa.int32())), pa.array(digests, pa.binary()),
            ]
            kept = ["page_id", "url", "k1", "k2"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made], names=[*kept, "lines", "numbers", "article"])


def _difference(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Numbers of the open lines that a page shares with a page beside it (one
    without open lines is not here, and what stood on its two sides is not beside
    each other)."""
    for g in contiguous(frames, ["host_key", "pair"]):
        found, articles, at = [list(x) for x in g["open"]], list(g["article"]), g["at"].tolist()
        deleted: list[set[int]] = [set() for _ in found]
        for i in range(len(found) - 1):
            if at[i + 1] != at[i] + 1:
                continue
            x, y = shared(found[i], found[i + 1])
            same = len(x) == len(found[i]) and len(y) == len(found[i + 1])
            if same and articles[i] == articles[i + 1]:
                continue  # the pages are copies
            for k, z in ((i, x), (i + 1, y)):
                if not same or articles[k] is not None:  # a page without an article is not emptied
                    deleted[k] |= z
        out = pd.DataFrame({"k1": g["k1"].to_numpy(), "k2": g["k2"].to_numpy(), "deleted": [sorted(d) for d in deleted]})
        yield out[out["deleted"].str.len() > 0]


def neighbours(pages: DataFrame) -> DataFrame:
    """(key1, key2, host_key, pair, place): which pages are compared.

    Hosts are ordered by a range shuffle, so one host's pages may lie in many
    tasks; a page's place in its host is its place in the task plus the counts
    of earlier tasks, of which there is one row per host and task."""
    url = F.lower(F.coalesce("url", F.lit("")))
    host = F.regexp_replace(F.regexp_extract(url, r"^(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)", 1), r"^www\.|:\d+$", "")
    path = F.regexp_replace(url, r"^(?:[a-z][a-z0-9+.-]*:)?//[^/?#]*", "")
    narrow = pages.select(host.alias("host"), path.alias("path"), "page_id", "k1", "k2")
    order = ["host", "path", "page_id", "k1", "k2"]
    placed = materialize(
        narrow.repartitionByRange(partitions(pages), *order)
        .sortWithinPartitions(*order)
        .select("host", "k1", "k2")
        .mapInPandas(_ranks, "host string, k1 long, k2 int, part int, place long"),
        "places",
    )
    counts = placed.groupBy("host", "part").agg(F.count("*").alias("n"))
    by = Window.partitionBy("host")
    before = F.coalesce(F.sum("n").over(by.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("host", "part", before.alias("before"), F.sum("n").over(by).alias("total"))
    at = F.col("place") + F.col("before")
    last = F.greatest(F.floor((F.col("total") - 2) / 2), F.lit(0))
    pair = F.least(F.floor(at / 2), last)
    return placed.join(offsets, ["host", "part"]).select(
        "k1", "k2", F.xxhash64("host").alias("host_key"), pair.alias("pair"), at.alias("at")
    )


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), one row per row of ``pages``.

    Reads page_id, url and html; other columns do not matter, whatever their
    names. A null or empty html gives an empty text, a null url an empty host
    and path; equal rows are extracted once for each. Pages of any length are
    read whole, in time that grows with their length (but for repeated lines
    that two paired pages have in different orders). Each page is parsed once;
    its lines are written to the shared folder, only those that markup leaves
    open travel between pages, and the numbers of deleted lines meet their page
    by a unique key. Character references are decoded, white space inside a
    block becomes one space, and blocks are joined by one space. An empty table
    gives no rows.
    """
    keys = ["k1", "k2"]
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").withColumns(
        {"k1": F.xxhash64("page_id", "url", "html"), "k2": F.hash("page_id", "url", "html")}
    )
    schema = "page_id long, url string, k1 long, k2 int, lines array<string>, numbers array<int>, article binary"
    parsed = materialize(base.mapInArrow(_parsed, schema), "page-lines")
    found = F.filter(F.arrays_zip("lines", "numbers"), lambda x: x["numbers"] >= 0)
    one = parsed.select("page_id", "url", *keys, found["lines"].alias("open"), "article").dropDuplicates(keys)
    deleted = materialize(
        neighbours(one)
        .join(one.where(F.size("open") > 0).select(*keys, "open", "article"), keys)
        .repartition(partitions(pages), "host_key", "pair")
        .sortWithinPartitions("host_key", "pair", "at")
        .mapInPandas(_difference, "k1 long, k2 int, deleted array<int>"),
        "deleted-lines",
    )
    told = parsed.join(deleted, keys, "left").withColumn("deleted", F.coalesce("deleted", F.array().cast("array<int>")))
    left = F.filter(F.arrays_zip("lines", "numbers"), lambda x: ~F.array_contains(F.col("deleted"), x["numbers"]))
    text = F.array_join(left["lines"], " ")
    return told.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
