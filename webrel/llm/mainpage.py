"""Main text of web pages (operator 9): nearest-URL page differencing.

A page is cut into blocks (the text lines between block tags), each with its
place: inside an ``article``, inside ``main``, or in the open body.  Menus,
headers, footers, sidebars, notices, adverts, forms, reader comments, scripts and
styles are told by element, role, class or id and left out.

* Every page is compared with the nearest page: pages are paired by URL path
  within their host (the neighbour in path order that shares the longer beginning
  of the path), the two lists of lines are aligned by their longest common
  subsequence, and the shared lines are furniture of the site.  If all lines are
  shared (two addresses of one page) none is.
* In a page that marks no article the shared lines are deleted.
* A page that says where its article is (``article``, else ``main``) is its blocks
  there, as the menus of two pages often differ; lines of its own, not the shared
  ones, tell whether ``main`` or its articles are the text.  A check of the elements
  follows the differencing: passages that two articles quote are article text, so
  shared lines in elements of prose (paragraphs, headings, items, quotations, cells)
  stay; those that stand bare in the layout of the article are deleted, unless
  the whole article is written so.

Scale.  Parsing is an Arrow column function, run once for the lines and once for the
text.  For the pairs only line hashes travel: they are range-sorted by
(host, path, id), written once to the shared folder, and each row takes its
neighbours by a window inside its range; the row before a range comes from a table
of one row per range.  So one host with a third of all pages is spread over many
tasks.  The lines to delete then meet their page in one shuffle join.

Defined results: null and empty html give the empty text; a null or unreadable
url has no host and no partner, nor has a page without lines; a host with one page has no partner; repeated
rows are each other's neighbours and delete nothing; truncated markup ends where
the page ends; an empty table gives no rows; a long page is read whole; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import html as html_lib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webrel.llm.common import partitions, written

# --- fixed values -----------------------------------------------------------
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|select|svg|math|iframe|object|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?][^>]*(?:>|\Z)|</[^>]*(?:>|\Z)|([^<]+|<)", re.S | re.I)
ATTRIBUTE = re.compile(r"([^\s/=>][^\s/=>]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")   # one whole name=value
TOLD_BY = re.compile(r"class|id|role|hidden", re.I)
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl",
         "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr",
         "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "summary",
         "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
PROSE = {"blockquote", "caption", "dd", "dt", "figcaption", "h1", "h2", "h3", "h4", "h5", "h6", "li", "p", "pre", "summary", "td", "th"}
FURNITURE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "head", "search"}
FURNITURE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
FURNITURE_NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion",
                   "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "sidebar",
                   "aside", "related", "comment", "comments", "disqus", "notice", "cookie", "cookies", "consent", "gdpr",
                   "banner", "popup", "modal", "newsletter", "subscribe", "share", "sharing", "social", "pagination", "pager", "widget"}
NEGATED = {"no", "not", "non", "without", "hide", "has", "have", "with"}   # "no-sidebar" tells of the layout
WITH_ARTICLES = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion",
                 "related", "comment", "comments", "disqus", "newsletter", "widget", "notice", "popup", "modal"}   # may hold teasers
GENERIC = {"area", "bar", "block", "body", "bottom", "box", "btn", "button", "buttons", "card", "children", "col", "container", "content", "contents",
           "count", "cta", "desktop", "element", "fixed", "form", "global", "group", "has", "heading", "holder", "icon", "icons", "inline", "inner", "item",
           "items", "label", "left", "link", "links", "list", "main", "mobile", "module", "outer", "page", "panel", "post", "posts", "primary", "right",
           "row", "section", "signup", "site", "slot", "small", "sticky", "text", "title", "toolbar", "top", "unit", "wrap", "wrapper", "zone"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}}
LIMITS = {"ul", "ol", "dl", "table", "article", "main", "section", "div", "body", "nav", "aside", "header", "footer", "form"}
# ---------------------------------------------------------------------------


def _names(value: str, inside_article: bool) -> tuple[set[str], set[str]]:
    """Parts of the names in a class or id that tell furniture: whole names, and parts of longer ones.
    Inside an article a longer name tells it only if it says nothing else ("share-buttons"): "share-of-market" may
    be what the article is about."""
    whole, part = set(), set()
    for name in value.split():
        parts = [x for x in re.split(r"[_:-]+", name) if x]
        if inside_article and any(x not in FURNITURE_NAMES and x not in GENERIC and x not in NEGATED and len(x) > 2 for x in parts):
            continue
        for n, x in enumerate(parts):
            if x in NEGATED:
                break
            if x in FURNITURE_NAMES:
                (whole if len(parts) == 1 else part).add(x)
    return whole, part


def _is_furniture(tag: str, attributes: str, inside_article: bool) -> str:
    """Empty: no; ``"wrapper"``: only by a part of a longer name, as a layout around the
    article may be called; ``"yes"``."""
    if tag in FURNITURE and not (tag == "header" and inside_article):
        return "yes"
    if not attributes or not TOLD_BY.search(attributes):
        return ""
    given: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(attributes):
        given.setdefault(m[1].lower(), (m[2] or m[3] or m[4] or "").strip().lower())   # the first counts
    if ("hidden" in given and given["hidden"] != "until-found") or given.get("aria-hidden") == "true" or given.get("role") in FURNITURE_ROLES:
        return "" if tag in ("html", "body") else "yes"
    if tag in ("html", "body", "main"):
        return ""
    whole, part = (a | b for a, b in zip(_names(given.get("class", ""), inside_article), _names(given.get("id", ""), inside_article), strict=True))
    if tag == "article":
        return "yes" if (whole | part) & {"comment", "comments", "ad", "ads", "related", "promo"} else ""
    if inside_article:   # a header of the article is kept, as the element is
        whole, part = whole - {"header"}, part - {"header"}
    return "yes" if whole or part & WITH_ARTICLES else "wrapper" if part else ""


def _blocks(page: str, wrappers: frozenset[int] = frozenset()) -> list[tuple[int, str, bool]]:
    """``(place, text, prose)`` of the blocks outside furniture; place 2: article, 1: main, 0: open; prose: an
    element of prose holds the text within that place.

    An element told by a part of a longer name only ("layout sidebar-left") is no furniture
    if it holds ``main`` or every article of the page; ``wrappers`` are the places of such."""
    out: list[tuple[int, str, bool]] = []
    stack: list[tuple[str, int, bool]] = []   # tag, place, furniture
    place, furniture, parts = 0, False, []
    maybe: list[tuple[int, int]] = []         # depth in the stack and place in the page of possible wrappers that are open
    held: dict[int, int] = {}                 # articles in each; a page's number of articles for one with main
    articles, with_main = 0, set()

    def flush():
        if parts:
            text = " ".join(html_lib.unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append((place, text, any(tag in PROSE and within == place for tag, within, _ in stack)))

    def back_to(n: int):
        nonlocal place, furniture
        del stack[n:]
        while maybe and maybe[-1][0] >= n:
            maybe.pop()
        place, furniture = (stack[-1][1], stack[-1][2]) if stack else (0, False)

    for m in TOKEN.finditer(page):
        text, tag = m[5], m[3]
        if text is not None:
            if not furniture:
                parts.append(text)
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if tag in BLOCK:
            flush()
        if m[2]:
            for n in range(len(stack) - 1, -1, -1):
                if stack[n][0] == tag:
                    back_to(n)
                    break
                if stack[n][0] in LIMITS and tag not in LIMITS:
                    break
            continue
        if tag == "br":
            parts.append(" ")
        if tag in VOID:
            continue
        ends = CLOSES.get(tag)
        if tag in BLOCK and tag not in ("html", "body", "head"):
            for n in range(len(stack) - 1, -1, -1):
                if stack[n][0] == "p" or (ends and stack[n][0] in ends):
                    back_to(n)
                elif stack[n][0] in BLOCK and not (ends and stack[n][0] not in LIMITS):
                    break
        elif tag == "body":
            back_to(0)
        kind = {"article": 2, "main": 1}.get(tag, 0)
        hides = _is_furniture(tag, m[4], place == 2)
        if hides == "wrapper" and (m.start() in wrappers or place == 2):
            hides = "" if m.start() in wrappers else "yes"
        if kind and not hides and place < 2 and not (furniture and not maybe):
            articles += kind == 2
            for _, at in maybe:
                held[at] = held.get(at, 0) + (kind == 2)
                with_main |= {at} if kind == 1 else set()
        if hides == "wrapper" and (maybe or not furniture):
            maybe.append((len(stack), m.start()))
        place, furniture = max(place, kind), furniture or bool(hides)
        stack.append((tag, place, furniture))
    flush()
    around = with_main | {at for at, n in held.items() if n and n == articles}
    return _blocks(page, wrappers | around) if around - wrappers else out


def blocks(page: str) -> list[tuple[int, str]]:
    """``(place, text)`` of the blocks outside furniture; place 2: article, 1: main, 0: open."""
    return [(place, text) for place, text, _ in _blocks(page)]


def _place(found: list[tuple[int, str, bool]], shared: set[int]) -> int:
    """Place of the text.  Where ``main`` says more outside its articles than in them, these are teasers beside
    the text; lines shared with the nearest page say nothing, unless all marked ones are shared."""
    said = [sum(len(t) for k, (p, t, _) in enumerate(found) if p == place and k not in shared) for place in (1, 2)]
    if shared and not any(said):
        return _place(found, set())
    return 1 if said[0] > said[1] else max((p for p, _, _ in found), default=0)


def article(page: str) -> list[str] | None:
    """Blocks of the article that the page marks; None if it marks none."""
    found = _blocks(page)
    top = _place(found, set())
    return [t for p, t, _ in found if p == top] if top else (None if found else [])


def main_text(page: str, shared: set[int]) -> list[str]:
    """Blocks of the page's text; ``shared``: the numbers of its lines that the nearest page has too.  In a marked
    article that has prose these are furniture only outside prose."""
    found = _blocks(page)
    top = _place(found, shared)
    prose = top > 0 and any(is_prose for p, _, is_prose in found if p == top)
    kept = (p == top and not (prose and k in shared and not is_prose) if top else k not in shared for k, (p, _, is_prose) in enumerate(found))
    return [t for (_, t, _), keep in zip(found, kept, strict=True) if keep]


def _prefix_lengths(a: list, b: list) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` and each beginning of ``b``."""
    n, at = len(b), {}
    for j, y in enumerate(b):
        at[y] = at.get(y, 0) | 1 << j
    v = full = (1 << n) - 1
    for x in a:
        u = v & at.get(x, 0)
        v = ((v + u) | (v - u)) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little")[:n]
    return np.r_[0, np.cumsum(1 - bits.astype(np.int64))]


def common(a: list, b: list, base: int = 0) -> list[int]:
    """Positions in ``a`` of a longest common subsequence of both (linear memory)."""
    lead = 0
    while lead < min(len(a), len(b)) and a[lead] == b[lead]:
        lead += 1
    tail = 0
    while tail < min(len(a), len(b)) - lead and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    mid_a, mid_b = a[lead:len(a) - tail], b[lead:len(b) - tail]
    out = list(range(base, base + lead))
    if len(mid_a) == 1:
        out += [base + lead] if mid_a[0] in mid_b else []
    elif mid_a and mid_b:
        h = len(mid_a) // 2
        both = _prefix_lengths(mid_a[:h], mid_b) + _prefix_lengths(mid_a[h:][::-1], mid_b[::-1])[::-1]
        j = int(np.argmax(both))
        out += common(mid_a[:h], mid_b[:j], base + lead) + common(mid_a[h:], mid_b[j:], base + lead + h)
    return out + list(range(base + len(a) - tail, base + len(a)))


@F.arrow_udf(T.ArrayType(T.LongType()))
def _line_hashes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield pa.array([[xxhash.xxh3_64_intdigest(t.encode("utf-8", "replace")) - (1 << 63) for _, t in blocks(x.as_py() or "")]
                        for x in batch], pa.list_(pa.int64()))


@F.arrow_udf(T.StringType())
def _main_text(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for pages, shared in batches:
        yield pa.array(["\n".join(main_text(x.as_py() or "", set(s.as_py() or []))) for x, s in zip(pages, shared, strict=True)], pa.string())


def _shared_start(a: str, b: str) -> int:
    return bisect_left(range(min(len(a), len(b))), True, key=lambda n: a[:n + 1] != b[:n + 1])


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _shared_lines(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    for cols in batches:
        out = []
        for path, mine, *sides in zip(*(c.to_pylist() for c in cols), strict=True):
            near = [s for s in sides if s is not None]
            if not near:
                out.append([])
                continue
            other = max(near, key=lambda s: _shared_start(path, s["path"]))   # the first, if equal
            gone = common(mine, other["lines"])
            out.append([] if len(gone) == len(mine) else gone)
        yield pa.array(out, pa.list_(pa.int32()))


def furniture_lines(pages: DataFrame) -> DataFrame:
    """``rid``, ``host``, ``path``, ``id``, ``lines`` -> ``rid`` and the numbers of the
    lines shared with the nearest page of the host."""
    spark, order = pages.sparkSession, ["host", "path", "id", "rid"]
    ranged = (pages.where("host is not null").repartitionByRange(partitions(spark), *order)
              .withColumn("part", F.spark_partition_id()))
    ranged = written(ranged, "page-lines").where("size(lines) > 0")   # a page without lines is nobody's nearest
    here = F.struct("host", "path", "lines")
    inside = Window.partitionBy("part").orderBy(*order)
    rows = ranged.withColumn("before", F.lag(here).over(inside)).withColumn("after", F.lead(here).over(inside))
    key = F.struct(*order)
    ends = ranged.groupBy("part").agg(F.min_by(here, key).alias("first"), F.max_by(here, key).alias("last"))
    by_part = Window.orderBy("part")
    ends = ends.select("part", F.lag("last").over(by_part).alias("last_before"), F.lead("first").over(by_part).alias("first_after"))
    rows = rows.join(ends, "part")
    side = lambda c: F.when(c["host"] == F.col("host"), c)
    before, after = F.coalesce(F.col("before"), F.col("last_before")), F.coalesce(F.col("after"), F.col("first_after"))
    return rows.select("rid", _shared_lines(F.col("path"), F.col("lines"), side(before), side(after)).alias("gone"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: ``id``, ``url``, ``text``."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    part: Column = F.concat_ws("|", *[F.coalesce(F.md5(F.col(c).cast("string")), F.lit("-")) for c in ("id", "url", "html")])
    rows = rows.withColumn("rid", F.unhex(F.md5(part)))
    place = r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)([^?#]*)"
    narrow = rows.select(
        "rid", F.nullif(F.lower(F.regexp_extract("url", place, 1)), F.lit("")).alias("host"),
        F.regexp_extract("url", place, 2).alias("path"), "id", _line_hashes("html").alias("lines")).dropDuplicates(["rid"])
    return rows.join(furniture_lines(narrow), "rid", "left").select("id", "url", _main_text("html", "gone").alias("text"))
