"""HTML as relations.

A page is tokenised by one regex and the tokens of a few pages are read together
(``_pages``, a small Arrow function; numpy instead of a loop over the tokens): pairs of tags, repaired ends, depths and parents
are linear in the page.  The result is one row per page whose arrays (``arrays``) are
what the expressions of ``tree`` read; ``elements`` and ``texts`` are its nodes, exploded.
Text nodes are numbered by token, so the text inside an element is a ``slice`` of
the page's position-indexed text array.

Partitioning: ``parse`` hash-partitions the raw pages once by ``page_id`` (the html
strings, before anything multiplies them).  Nothing after it needs a window, sort or
join to build the tree, and pages that share an id stay apart.

Relations::

    tokens(page_id, pos, tok, kind, tag, text, tc)
        kind in open | close | void | text | raw | comment | doctype
        tc   = pos (kept as the text index; texts.tidx = pos)
    elements(page_id, start, end, start_tc, end_tc, tag, attrs, depth, parent_start)
        an element contains token t iff start < t.pos < end
    texts(page_id, pos, tidx, text, kind, depth, parent_start)
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field as dataclass_field
from functools import cached_property
from itertools import product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webrel.functions.text import unescape, unescaped

# --- fixed values -----------------------------------------------------------
# Tokeniser: comments, doctype, raw-text elements (kept whole so that "</p>"
# inside a script string is not a tag), tags with quoted attributes, text.
TOKEN_RE = (
    r"(?is)<!--.*?-->|<![a-z][^>]*>"
    r"|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>"
    r"|<textarea\b[^>]*>.*?</textarea\s*>"
    r"|</?[a-z][^\s/>]*(?:\"[^\"]*\"|'[^']*'|[^'\">])*+>|[^<]++|<"
)
# Elements without content (HTML void elements).
VOID_TAGS = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link",
             "meta", "param", "source", "track", "wbr"]
# Implied end tags: an unclosed element of the key tags ends where one of the
# listed start tags opens at the same nesting level (HTML parsing rules; the
# formatting group follows the HTML4 parser that closes b/i/u/... on <p>).
AUTO_CLOSE = {
    "p": (["p"], ["address", "article", "aside", "blockquote", "details", "div", "dl",
                  "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3",
                  "h4", "h5", "h6", "header", "hgroup", "hr", "li", "main", "menu", "nav",
                  "ol", "p", "pre", "section", "table", "ul", "dd", "dt"]),
    "li": (["li"], ["li"]),
    "dtdd": (["dt", "dd"], ["dt", "dd"]),
    "tr": (["tr"], ["tr", "tbody", "thead", "tfoot"]),
    "cell": (["td", "th"], ["td", "th", "tr", "tbody", "thead", "tfoot"]),
    "option": (["option"], ["option", "optgroup"]),
    "head": (["head"], ["body"]),
    "font": (["b", "i", "u", "s", "tt", "big", "small", "strike"], ["p"]),
}
# Attribute name / value pattern inside a start tag.
ATTR_RE = r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?"""
# ---------------------------------------------------------------------------

_RAW_OPEN = r"(?is)^<(script|style|textarea)\b"
_RAW_SPLIT = r"(?is)^(<[^>]*>)(.*)(</[a-z]+\s*>)$"


@dataclass
class Dom:
    tokens: DataFrame
    elements: DataFrame
    texts: DataFrame
    txt: DataFrame | None = None   # (page_id, txt) position-indexed text arrays
    base: DataFrame | None = None  # elements without depth/parent (cheaper; no extra windows)
    arrays: DataFrame | None = None  # (page_id, txt, nodes) the arrays of a page, one row per page
    sources: DataFrame | None = None  # the same with the tokens: (page_id, toks, txt, nodes)
    html: DataFrame | None = None  # (page_id, html) for expressions over single pages; after the page exchange, or as given if spread

    @property
    def el(self) -> DataFrame:
        """Elements for operators that need no parent/depth columns."""
        return self.base if self.base is not None else self.elements

    def page_texts(self) -> DataFrame:
        """One row per page: ``txt`` = array of all text nodes in order."""
        return self.txt if self.txt is not None else page_texts(self.tokens)

    def persist(self) -> "Dom":
        """Keep the three relations (memory, spilling to disk) when several
        outputs are derived from one parse; lost blocks are recomputed from
        lineage.  Pair with ``unpersist``."""
        from pyspark import StorageLevel
        lvl = StorageLevel.MEMORY_AND_DISK
        return Dom(self.tokens.persist(lvl), self.elements.persist(lvl), self.texts.persist(lvl),
                   self.txt.persist(lvl) if self.txt is not None else None, None, self.arrays, self.sources, self.html)

    def unpersist(self) -> None:
        for df in (self.tokens, self.elements, self.texts, self.txt):
            if df is not None:
                df.unpersist()


def dom_partitions(spark) -> int:
    """Partitions for the page exchange: ``spark.sql.shuffle.partitions``, at
    least the default parallelism (sized by the cluster for its data)."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(n, spark.sparkContext.defaultParallelism)


def _kind(tok: Column, k: Column) -> Column:
    tagname = F.lower(F.regexp_extract(tok, r"^</?([a-zA-Z][^\s/>]*)", 1))
    return (F.when(k.isNotNull(), k)
            .when(tok.startswith("<!--"), F.lit("comment"))
            .when(tok.startswith("<!"), F.lit("doctype"))
            .when(tok.rlike(r"^</[a-zA-Z]"), F.lit("close"))
            .when(tok.rlike(r"^<[a-zA-Z]"), F.when(tagname.isin(VOID_TAGS), F.lit("void")).otherwise(F.lit("open")))
            .otherwise(F.lit("text")))


def _text(tok: Column, kind: Column) -> Column:
    return F.when(kind == "text", unescape(tok)).when(kind == "raw", tok)


def _bare(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    return pages.select(F.col(id_col).alias("page_id"), F.col(html_col).cast("string").cast("binary").alias("html"))


def _by_page(pages: DataFrame, id_col: str, html_col: str, partitions: int | None) -> DataFrame:
    """The one page exchange: ``page_id, html``."""
    return _bare(pages, id_col, html_col).repartition(partitions or dom_partitions(pages.sparkSession), "page_id")


def page_arrays(pages: DataFrame, id_col: str = "page_id", html_col: str = "html",
                partitions: int | None = None, sources: bool = True) -> DataFrame:
    """``(page_id, toks, txt, nodes)`` after the one page exchange: the tokens
    ``ARRAY<STRUCT<tok, k>>`` (only with ``sources``), the text at every token (NULL for markup),
    and the elements and text nodes in document order.

    An explicit partition count: the exchange carries compact html and what follows
    multiplies it, so AQE must not coalesce it by its (small) shuffle size.  The count
    follows the cluster's shuffle setting.
    """
    src = _by_page(pages, id_col, html_col, partitions)
    # not deterministic for the planner: no filter on its result is pushed below it, so a page is read once
    read = F.arrow_udf(_read_pages(sources), SOURCES_TYPE if sources else PAGE_TYPE).asNondeterministic()
    return src.select("page_id", read("html").alias("p")).select("page_id", *(["p.toks"] if sources else []), "p.txt", "p.nodes")


def tokenize(pages: DataFrame, id_col: str = "page_id", html_col: str = "html",
             partitions: int | None = None, arrays: DataFrame | None = None) -> DataFrame:
    """Ordered token table; lossless (``concat(tok) = html``).

    The raw pages are hash-partitioned by ``id_col`` *before* the explode so
    the one exchange moves compact html strings, and all later per-page
    windows run inside that partitioning.
    """
    arr = arrays if arrays is not None else page_arrays(pages, id_col, html_col, partitions)
    t = arr.select("page_id", F.size("toks").alias("n_tok"), F.posexplode("toks").alias("pos", "p"))
    tok = F.col("p.tok")
    kind = _kind(tok, F.col("p.k"))
    tagname = F.lower(F.regexp_extract(tok, r"^</?([a-zA-Z][^\s/>]*)", 1))
    t = t.select("page_id", F.col("pos").cast("int").alias("pos"), tok.alias("tok"), kind.alias("kind"),
                 F.when(kind.isin("open", "close", "void"), tagname).alias("tag"), F.col("n_tok").cast("int"))
    t = t.withColumn("text", _text(F.col("tok"), F.col("kind")))
    # text positions double as text indices: the text of an element is the
    # non-null run of the page's position-indexed text array (no running count)
    return t.withColumn("tc", F.col("pos"))


# --- one page, read in one pass ---------------------------------------------
NODE_FIELDS = ["start:int", "end:int", "tag:string", "attrs:map<string,string>", "void:boolean", "text:string", "parent:int",
               "kind:string", "depth:int", "parent_start:int", "nth:int", "nth_of_type:int"]
NODE = f"struct<{','.join(NODE_FIELDS)}>"
TEXT_NODE = "struct<start:int,text:string,parent:int>"
PAGE_TYPE = f"struct<txt:array<string>,nodes:array<{NODE}>>"
SOURCES_TYPE = PAGE_TYPE.replace("struct<", "struct<toks:array<struct<tok:string,k:string>>,", 1)
PAGE_CHARS = 1 << 20   # pages are read together up to so many characters
KINDS = ["text", "raw", "open", "close", "void", "comment", "doctype"]
TEXT, RAW, OPEN, CLOSE, VOID = range(5)

# the patterns above in Python; as in Java only letters of ASCII have a case and \\s is ASCII
# and the kinds of a token do not exclude each other by order alone: text comes first, names of raw texts spell both cases and
# what lies between quotes is taken in runs, which is several times faster and finds the same tokens
_RAW_TEXTS = ["script", "style", "textarea"]
_RAW_NAMES = [re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", n) for n in _RAW_TEXTS]
_PY_TOKEN = re.compile(
    r"[^<]++|<!--.*?-->|<![a-zA-Z][^>]*>|" + "|".join(rf"<{n}\b[^>]*>.*?</{n}\s*>" for n in _RAW_NAMES)
    + r"""|</?[a-zA-Z][^\s/>]*(?:"[^"]*"|'[^']*'|[^'">]++)*+>|<""", re.ASCII | re.DOTALL)
_PY_RAW_OPEN = re.compile(r"<(?ai:script|style|textarea)\b")
_RAW_STARTS = frozenset("<" + "".join(c) for n in ("scr", "sty", "tex") for c in product(*zip(n, n.upper())))
_PY_RAW_END = re.compile(r"(?is)</[a-z]+\s*>\Z", re.ASCII)
_PY_RAW_SPLIT = re.compile(r"(?is)(<[^>]*>)(.*)(</[a-z]+\s*>)\Z", re.ASCII)
_PY_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)", re.ASCII)
# markup without < or > inside: what lies from a "<" to the next ">" is a token of the pattern above
_PLAIN = re.compile(r"""<(?:!--[^<>]*--|![a-zA-Z][^<>]*|(/?)([a-zA-Z][^\s/>"'<]*)(?:[\s/](?:[^"'<>]++|"[^"<>]*"|'[^'<>]*')*+)?)>""", re.ASCII)
_RAW_BYTES = re.compile("|".join(rf"<{n}\b[^>]*>(.*?)</{n}\s*>" for n in _RAW_NAMES).encode(), re.DOTALL)
_RAW_LETTERS = [int.from_bytes(n[:3].encode()) for n in _RAW_TEXTS]
_PY_ATTR = re.compile(ATTR_RE, re.ASCII)
_VOID = frozenset(VOID_TAGS)
_CLOSERS = [(frozenset(tags), frozenset(closers)) for tags, closers in AUTO_CLOSE.values()]



def _token_kind(tok: str, k: str | None) -> tuple[str, str | None]:
    """Kind and tag name of a token, as ``_kind``."""
    if k is not None:
        return k, None
    if tok.startswith("<!"):
        return ("comment" if tok.startswith("<!--") else "doctype"), None
    m = _PY_TAG.match(tok)
    if m is None:
        return "text", None
    tag = m[1].lower()
    return ("close" if tok[1] == "/" else "void" if tag in VOID_TAGS else "open"), tag


def _kind_and_tag(tok: str) -> tuple[int, str | None]:
    name, tag = _token_kind(tok, None) if tok[:1] == "<" else ("text", None)
    return KINDS.index(name), tag


def _attrs(tok: str) -> tuple[tuple[str, str], ...]:
    """Attributes of a start tag; names lower-cased, first duplicate wins, values entity-decoded."""
    inside = tok[_PY_TAG.match(tok).end():].removesuffix(">").removesuffix("/")
    if not inside:
        return ()
    out: dict[str, str] = {}
    for name, a, b, c in _PY_ATTR.findall(inside):
        out.setdefault(name.lower(), unescaped(a + b + c))
    return tuple(out.items())


def _tokens(html: str) -> tuple[list[str], list[int]]:
    """The tokens of a page and the places of its raw texts; a raw-text element becomes its tag, its content and
    its end tag."""
    found = _PY_TOKEN.findall(html)
    if not _PY_RAW_OPEN.search(html):
        return found, []
    toks: list[str] = []
    raws: list[int] = []
    done = 0
    for i in [i for i, t in enumerate(found) if t[:4] in _RAW_STARTS]:
        t = found[i]
        if _PY_RAW_OPEN.match(t) and _PY_RAW_END.search(t):
            m = _PY_RAW_SPLIT.match(t)
            toks += found[done:i]
            raws.append(len(toks) + 1)
            toks += m.groups() if m else ("", "", "")
            done = i + 1
    return toks + found[done:], raws


class _Coded(NamedTuple):
    """The tokens of some pages, one after the other, by their numbers among the different ones."""
    different: pa.Array
    kinds: list[int]         # of the different ones, and their tag names
    tags: list[str | None]
    code: np.ndarray
    page: np.ndarray
    raw: np.ndarray   # is it the content of a raw text


def _cut(htmls: list[str]) -> tuple[_Coded, np.ndarray]:
    """Tokens by the places of "<", ">" and raw texts alone, and the pages where these do not tell the tokens of the
    pattern: with "<" or ">" inside markup."""
    sizes = np.array([len(h) if h.isascii() else len(h.encode()) for h in htmls], np.int64)
    page_bytes = "".join(htmls).encode()
    data = np.frombuffer(page_bytes, np.uint8)
    till = np.cumsum(sizes)
    less, greater = np.flatnonzero(data == ord("<")), np.flatnonzero(data == ord(">"))
    letters = np.r_[data, 0, 0, 0] | 32
    names = (letters[less + 1].astype(np.int64) << 16) + (letters[less + 2].astype(np.int64) << 8) + letters[less + 3]
    maybe = less[np.isin(names, _RAW_LETTERS)]
    raws, reached = [], 0
    for at, end in zip(maybe.tolist(), till[np.searchsorted(till, maybe, "right")].tolist(), strict=True):
        if at >= reached and (m := _RAW_BYTES.match(page_bytes, at, end)):
            raws.append(m.span(m.lastindex))
            reached = m.end()
    low, high = np.array(raws, np.int64).reshape(-1, 2).T

    def outside(at: np.ndarray) -> np.ndarray:
        return at[np.searchsorted(low, at, "right") == np.searchsorted(high, at, "right")]

    less, greater = outside(less), outside(greater)
    after = np.r_[greater, len(data)][np.searchsorted(greater, less)] + 1
    of = np.searchsorted(till, less, "right")
    whole = after <= np.minimum(np.r_[less[1:], len(data)][:len(less)], till[of])
    odd = np.zeros(len(htmls), bool)
    odd[of[~whole]] = True
    begins = np.zeros(len(data) + 1, bool)
    begins[less] = begins[after[whole]] = begins[till - sizes] = begins[low] = True
    starts = np.flatnonzero(begins[:-1])
    page = np.searchsorted(till, starts, "right")
    cut = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.r_[starts, len(data)].astype(np.int32)), pa.py_buffer(data)).dictionary_encode()
    code = cut.indices.to_numpy().astype(np.int64)
    raw = np.zeros(len(code), bool)
    raw[np.searchsorted(starts, low[low < high])] = True
    n = len(cut.dictionary)
    kinds, tags, wrong = [TEXT] * (n + 1), [None] * (n + 1), []
    for i, t in enumerate(cut.dictionary.to_pylist()):
        if t[0] != "<":
            continue
        m = _PLAIN.fullmatch(t)
        if m is None or m[2] is None:
            kinds[i], tags[i] = _kind_and_tag(t)
            if m is None:
                wrong.append(i)
        else:
            tags[i] = name = m[2].lower()
            kinds[i] = CLOSE if m[1] else VOID if name in _VOID else OPEN
    if wrong:
        odd[page[np.isin(code, wrong) & ~raw]] = True
    empty = low[low == high]     # raw texts without content are tokens too
    gaps = np.searchsorted(starts, empty)
    different = pa.concat_arrays([cut.dictionary, pa.array([""], pa.string())])
    return _Coded(different, kinds, tags, np.insert(code, gaps, n), np.insert(page, gaps, page[gaps]), np.insert(raw, gaps, True)), odd


def _coded(htmls: list[str]) -> _Coded:
    """The tokens of some pages; pages that ``_cut`` cannot tell are read by the pattern."""
    cut, odd = _cut(htmls)
    if not odd.any():
        return cut
    number = {t: i for i, t in enumerate(cut.different.to_pylist())}
    n = len(number)
    code, page, raw = [], [], []
    for i in np.flatnonzero(odd).tolist():
        toks, raws = _tokens(htmls[i])
        code += [number.setdefault(t, len(number)) for t in toks]
        page += [i] * len(toks)
        is_raw = np.zeros(len(toks), bool)
        is_raw[raws] = True
        raw.append(is_raw)
    plain = ~odd[cut.page]
    pages = np.r_[cut.page[plain], np.array(page, np.int64)]
    order = np.argsort(pages, kind="stable")
    new = list(number)[n:]
    different = pa.concat_arrays([cut.different, pa.array(new, pa.string())])
    kinds, tags = zip(*[_kind_and_tag(t) for t in new]) if new else ((), ())
    return _Coded(different, [*cut.kinds, *kinds], [*cut.tags, *tags], np.r_[cut.code[plain], np.array(code, np.int64)][order], pages[order], np.r_[cut.raw[plain], *raw][order])


class _Marks(NamedTuple):
    """The tokens of some pages, one after the other."""
    page: np.ndarray   # of each token,
    first: np.ndarray  # and the first token of each page, with the number of all tokens at the end
    kind: np.ndarray   # place in ``KINDS``
    tag: np.ndarray    # number of the tag name, -1: none
    names: list[str]


def _groups(keys: tuple[np.ndarray, ...], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by keys, then place; and, in that order, whether a group begins."""
    order = np.lexsort((at, *keys))
    new = np.ones(len(at), bool)
    if len(at):
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    return order, new


def _numbered(keys: tuple[np.ndarray, ...], at: np.ndarray) -> np.ndarray:
    """Number (from 1) of each row among those with equal keys, by place."""
    order, new = _groups(keys, at)
    out = np.empty(len(at), np.int64)
    rank = np.arange(len(at))
    out[order] = rank - np.maximum.accumulate(np.where(new, rank, 0)) + 1
    return out


def _nearest(m: _Marks, level: np.ndarray, of: np.ndarray, wanted: np.ndarray, at: np.ndarray, after: bool) -> np.ndarray:
    """For each token of ``at`` the nearest token of ``of`` in its page, after or before it, whose level is
    ``wanted`` (-1: none)."""
    n = len(m.page) + 1
    order = np.lexsort((of, level[of]))
    keys = (level[of] * n + of)[order]
    k = np.searchsorted(keys, wanted * n + at, "right" if after else "left") - (0 if after else 1)
    out = np.full(len(at), -1)
    ok = (k >= 0) & (k < len(keys))
    hit = of[order[k[ok]]]
    out[ok] = np.where((level[hit] == wanted[ok]) & (m.page[hit] == m.page[at[ok]]), hit, -1)
    return out


def _ends(m: _Marks) -> np.ndarray:
    """The token at which each element ends (-1 for other tokens).  A start tag pairs with the end tag that is
    next on its level among the tags of its name; another element ends where a tag implies it (``AUTO_CLOSE``) or
    the pair around it closes, whichever comes first, at the latest with the page."""
    opens = m.kind == OPEN
    both = np.flatnonzero(opens | (m.kind == CLOSE))
    order, new = _groups((m.tag[both], m.page[both]), both)
    both = both[order]
    step = np.where(opens[both], 1, -1)
    level = np.cumsum(step)
    group = np.cumsum(new) - 1
    level = level - (level - step)[new][group] + (step < 0) if len(both) else level
    order, new = _groups((level, group), both)
    both = both[order]
    pairs = ~new[1:] & opens[both[:-1]] & ~opens[both[1:]]
    ends = np.full(len(m.page), -1)
    ends[both[:-1][pairs]] = both[1:][pairs]
    closing = np.zeros(len(m.page), bool)
    closing[both[1:][pairs]] = True
    change = (ends >= 0).astype(np.int64) - closing
    around = np.cumsum(change) - change                       # pairs around a token
    ends[m.kind == VOID] = np.flatnonzero(m.kind == VOID)
    left = np.flatnonzero(opens & (ends < 0))
    if len(left):
        till = m.first[m.page[left] + 1]
        found = _nearest(m, around, np.flatnonzero(closing), around[left], left, True)
        till = np.where(found >= 0, np.minimum(till, np.maximum(found, 0)), till)
        starts = opens | (m.kind == VOID)
        for tags, closers in _CLOSERS:
            mine = np.isin(m.tag[left], [k for k, n in enumerate(m.names) if n in tags])
            if mine.any():
                by = np.flatnonzero(starts & np.isin(m.tag, [k for k, n in enumerate(m.names) if n in closers]))
                found = _nearest(m, around, by, around[left[mine]], left[mine], True)
                till[mine] = np.where(found >= 0, np.minimum(till[mine], found), till[mine])
        ends[left] = till
    return ends


def _parents(m: _Marks, ends: np.ndarray, depth: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """The start of the innermost element around each of ``nodes``, the last that began and is open (-1: none)."""
    opens = np.flatnonzero(m.kind == OPEN)
    out = _nearest(m, depth, opens, depth[nodes] - 1, nodes, False)
    is_open, around = m.kind[nodes] == OPEN, depth[nodes] > 0
    # where tags cross, the last element a level above need not be open
    odd = around & is_open & ((out < 0) | (ends[out] <= nodes) | (ends[nodes] > ends[out]))
    page = m.page[nodes]
    for p in np.unique(page[odd]):
        here = np.arange(*np.searchsorted(page, [p, p + 1]))
        ending: dict[int, list[int]] = {}
        for start in nodes[here[is_open[here]]].tolist():
            ending.setdefault(int(ends[start]), []).append(start)
        at = sorted(ending)
        stack: dict[int, None] = {}
        k = 0
        for i, pos in zip(here.tolist(), nodes[here].tolist(), strict=True):
            while k < len(at) and at[k] <= pos:
                for start in ending[at[k]]:
                    stack.pop(start, None)
                k += 1
            out[i] = next(reversed(stack), -1)
            if is_open[i]:
                stack[pos] = None
    return out


def _ints(values: np.ndarray, missing: np.ndarray | None = None) -> pa.Array:
    return pa.array(values.astype(np.int32), pa.int32(), mask=missing)


def _lists(counts: np.ndarray, items: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(_ints(np.r_[0, np.cumsum(counts)]), items)


def _maps(rows: list) -> pa.Array:
    """One Arrow map per row from its pairs (None: no pairs)."""
    pairs = [p for r in rows if r for p in r]
    offsets = np.r_[0, np.cumsum([len(r) if r else 0 for r in rows])]
    return pa.MapArray.from_arrays(_ints(offsets), *[pa.array([p[k] for p in pairs], pa.string()) for k in (0, 1)])


class _Read:
    """D01-D04 of some pages: tokens, texts and nodes; what is asked of them is found once.  A node has the start of
    the innermost element around it (``parent``) and of the last one that starts a level above it (``parent_start``);
    they differ where tags cross.  An element is the ``nth`` element of its ``parent`` and the ``nth_of_type`` with its tag."""

    def __init__(self, htmls: list[str], may: Callable[[str, str], bool] | None = None):
        """``may``: of which tags the attributes are read, by name and source (None: all)."""
        coded = _coded(htmls)
        self.different, self.code, code = coded.different, coded.code, coded.code
        self.counts = np.bincount(coded.page, minlength=len(htmls))
        numbers: dict[str, int] = {}
        n = len(coded.different)                              # what is asked of a token is read once
        self.attrs: list[tuple | None] = [None] * n
        self.with_attrs: list[tuple[int, str]] = []           # the tokens whose attributes are read, and their tags
        for i, (k, of, t) in enumerate(zip(coded.kinds, coded.tags, coded.different.to_pylist(), strict=True)):
            if k in (OPEN, VOID) and (may is None or may(of, t)):
                self.attrs[i] = _attrs(t)
                self.with_attrs.append((i, of))
        kind = np.array(coded.kinds, np.int64)
        tag = np.array([-1 if of is None else numbers.setdefault(of, len(numbers)) for of in coded.tags], np.int64)
        self.text = kind == TEXT
        kind, tag = kind[code], tag[code]
        kind[coded.raw], tag[coded.raw] = RAW, -1
        first = np.r_[0, np.cumsum(self.counts)]
        self.marks = _Marks(coded.page, first, kind, tag, list(numbers))
        self.nodes = np.flatnonzero(np.isin(kind, (TEXT, RAW, OPEN, VOID)))
        self.element = tag[self.nodes] >= 0
        self.origin = first[self.marks.page[self.nodes]]      # first token of the page of a node

    @cached_property
    def ends(self) -> np.ndarray:
        return _ends(self.marks)

    @cached_property
    def depth(self) -> np.ndarray:
        opens, n = self.marks.kind == OPEN, len(self.code)
        return np.cumsum(opens) - opens - np.cumsum(np.bincount(self.ends[opens], minlength=n + 1)[:n])

    @cached_property
    def parent(self) -> np.ndarray:
        return _parents(self.marks, self.ends, self.depth, self.nodes)

    @cached_property
    def above(self) -> np.ndarray:
        return _nearest(self.marks, self.depth, self.nodes[self.element], self.depth[self.nodes] - 1, self.nodes, False)

    @cached_property
    def numbers(self) -> dict[str, np.ndarray]:
        at = self.nodes[self.element]
        within = np.where(self.parent < 0, len(self.code) + self.marks.page[self.nodes], self.parent)[self.element]
        out = {"nth": np.zeros(len(self.nodes), np.int64), "nth_of_type": np.zeros(len(self.nodes), np.int64)}
        out["nth"][self.element] = _numbered((within,), at)
        out["nth_of_type"][self.element] = _numbered((self.marks.tag[at], within), at)
        return out

    @cached_property
    def shown(self) -> tuple[pa.Array, np.ndarray]:
        """The different tokens and, after them, the texts that read otherwise; and for each token which of them it shows."""
        held = np.flatnonzero(self.text & pc.match_substring(self.different, "&").to_numpy(zero_copy_only=False))
        n = len(self.different)
        shows = np.arange(n)
        shows[held] = n + np.arange(len(held))
        texts = pa.array([unescaped(t) for t in self.different.take(pa.array(held)).to_pylist()], pa.string())
        return pa.concat_arrays([self.different, texts]), shows

    def txt(self, at: np.ndarray | None = None) -> pa.Array:
        """The text at every token, or at the tokens ``at``: of texts, and raw texts as they stand."""
        code, kind = (self.code, self.marks.kind) if at is None else (self.code[at], self.marks.kind[at])
        shown, shows = self.shown
        return shown.take(pa.array(np.where(kind == RAW, code, shows[code]), mask=~np.isin(kind, (TEXT, RAW))))

    def field(self, name: str, at: np.ndarray) -> pa.Array:
        """A field of the nodes ``at`` (places in ``nodes``)."""
        m, nodes, element, origin = self.marks, self.nodes[at], self.element[at], self.origin[at]
        if name == "start":
            return _ints(nodes - origin)
        if name == "end":
            return _ints(np.where(element, self.ends[nodes], nodes) - origin)
        if name == "tag":
            return pa.array(m.names, pa.string()).take(pa.array(m.tag[nodes], mask=~element))
        if name == "attrs":
            return self.maps.take(pa.array(self.code[nodes], mask=~element))
        if name == "void":
            return pa.array(m.kind[nodes] == VOID)
        if name == "text":
            return self.txt(nodes)
        if name == "kind":
            return pa.array(KINDS, pa.string()).take(pa.array(m.kind[nodes]))
        if name == "depth":
            return _ints(self.depth[nodes])
        if name in ("nth", "nth_of_type"):
            return _ints(self.numbers[name][at], ~element)
        up = (self.parent if name == "parent" else self.above)[at]
        return _ints(up - origin, up < 0)

    @cached_property
    def maps(self) -> pa.Array:
        return _maps(self.attrs)

    def lists(self, at: np.ndarray, items: pa.Array) -> pa.Array:
        """``items`` of the nodes ``at`` as one list per page."""
        return _lists(np.bincount(self.marks.page[self.nodes[at]], minlength=len(self.counts)), items)

    def structs(self, names: list[str], at: np.ndarray, **more: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([*[self.field(n, at) for n in names], *more.values()], [*names, *more])


def _pages(htmls: list[str], sources: bool) -> pa.Array:
    """Tokens (``sources``), texts and nodes of some pages."""
    r = _Read(htmls)
    every = np.arange(len(r.nodes))
    columns = [_lists(r.counts, r.txt()), r.lists(every, r.structs([f.split(":")[0] for f in NODE_FIELDS], every))]
    if not sources:
        return pa.StructArray.from_arrays(columns, ["txt", "nodes"])
    raw = pa.array(["raw"]).take(pa.array(np.zeros(len(r.code), np.int64), mask=r.marks.kind != RAW))
    tokens = pa.StructArray.from_arrays([r.different.take(pa.array(r.code)), raw], ["tok", "k"])
    return pa.StructArray.from_arrays([_lists(r.counts, tokens), *columns], ["toks", "txt", "nodes"])


@dataclass
class Asked:
    """What expressions ask of a page; its other nodes and fields are not handed over.  ``conditions``: a tag (None: any)
    and pairs of an attribute and a part of its value; an element that fits none of them is not asked for."""
    conditions: set[tuple] = dataclass_field(default_factory=set)
    elements: bool = False    # all of them
    texts: bool = False       # all of them, not only those inside elements asked for
    own: bool = False         # texts with their places and parents
    parents: bool = False
    positions: bool = False
    by_tag: dict[str, list] = dataclass_field(default_factory=dict)   # names of attributes that the conditions for a tag ask for, as met

    def wants(self, tag: str, attrs: dict[str, str]) -> bool:
        return self.elements or any((t is None or t == tag) and all(part in attrs.get(name, "") and name in attrs for name, part in pairs)
                                    for t, pairs in self.conditions)

    def may_want(self, tag: str, source: str) -> bool:
        """``wants``, before the attributes are read."""
        if self.elements:
            return True
        asked = self.by_tag.get(tag)
        if asked is None:
            asked = self.by_tag[tag] = [[name for name, _ in pairs] for t, pairs in self.conditions if t is None or t == tag]
        if not asked:
            return False
        low = source.lower()
        return any(all(name in low for name in names) for names in asked)

    @property
    def fields(self) -> list[str]:
        return ["start", "end", "tag", "attrs", "void", *(["parent"] if self.parents else []), *(["nth", "nth_of_type"] if self.positions else [])]

    @property
    def placed(self) -> bool:
        """Texts come with their places and parents."""
        return self.texts or self.own

    @property
    def type(self) -> str:
        kinds = dict(f.split(":", 1) for f in NODE_FIELDS)
        of = ",".join(f"{f}:{kinds[f]}" for f in self.fields)
        return f"struct<els:array<struct<{of},text_at:int,n_texts:int>>,texts:array<{TEXT_NODE if self.placed else 'string'}>>"

    def read(self, htmls: list[str]) -> pa.Array:
        """Elements that are asked for, each with the place and number of the texts inside it, and the texts."""
        r = _Read(htmls, self.may_want)
        m, n = r.marks, len(r.code)
        wanted = np.zeros(len(r.attrs), bool)
        for i, tag in r.with_attrs:
            wanted[i] = self.wants(tag, dict(r.attrs[i]))
        els = np.flatnonzero(r.element & wanted[r.code[r.nodes]]) if n else np.arange(0)
        starts, ends = r.nodes[els], r.ends[r.nodes[els]]
        inside = np.bincount(starts, minlength=n + 1)
        inside = np.cumsum(inside - np.bincount(np.maximum(ends, starts), minlength=n + 1))   # elements asked for around a token
        texts = np.flatnonzero(~r.element & (self.texts | (inside[r.nodes] > 0)))
        at = r.nodes[texts]
        low, high = np.searchsorted(at, starts, "right"), np.searchsorted(at, ends, "left")
        found = r.structs(self.fields, els, text_at=_ints(low - np.searchsorted(at, r.origin[els])), n_texts=_ints(np.maximum(high - low, 0)))
        shown = r.structs(["start", "text", "parent"], texts) if self.placed else r.field("text", texts)
        return pa.StructArray.from_arrays([r.lists(els, found), r.lists(texts, shown)], ["els", "texts"])


def _in_batches(read: Callable[[list[str]], pa.Array]):
    """``read`` of a batch of pages, a few at a time."""
    def run(html: pa.Array) -> pa.Array:
        parts, held, chars = [], [], 0
        for row in html:
            held.append(str(row.as_py() or b"", "utf-8", "replace"))
            chars += len(held[-1])
            if chars >= PAGE_CHARS:
                parts.append(read(held))
                held, chars = [], 0
        return pa.concat_arrays([*parts, read(held)])

    return run


def _read_pages(sources: bool):
    """``_pages`` of a batch; ``sources``: with the tokens."""
    return _in_batches(lambda htmls: _pages(htmls, sources))


def _nodes_of(htmls: list[str], element: bool, names: list[str]) -> pa.Array:
    """The elements or the text nodes of some pages, with the fields ``names``."""
    r = _Read(htmls)
    at = np.flatnonzero(r.element == element)
    return r.lists(at, r.structs(names, at))


def _node_rows(source: DataFrame, element: bool, names: list[str]) -> DataFrame:
    """One row ``page_id, n`` per element or per text node."""
    kinds = dict(f.split(":", 1) for f in NODE_FIELDS)
    read = F.arrow_udf(_in_batches(lambda htmls: _nodes_of(htmls, element, names)),
                       f"array<struct<{','.join(f'{n}:{kinds[n]}' for n in names)}>>").asNondeterministic()
    return exploded(source.select("page_id", read("html").alias("nodes")), "nodes", "n")


def parse(pages: DataFrame, id_col: str = "page_id", html_col: str = "html",
          partitions: int | None = None, spread: bool = False) -> Dom:
    """Tokens, elements (with attrs, depth, parent) and texts.  ``spread``: the pages lie in all tasks already,
    so expressions over single pages read them where they are."""
    sources = page_arrays(pages, id_col, html_col, partitions)
    arrays = page_arrays(pages, id_col, html_col, partitions, sources=False)
    src = _by_page(pages, id_col, html_col, partitions)
    plain = ["start", "end", "tag", "attrs", "void"]
    base, elements = [_node_rows(src, True, [*plain, *more]).select(
        "page_id", "n.start", "n.end", F.col("n.start").alias("start_tc"), F.col("n.end").alias("end_tc"), "n.tag", "n.attrs", "n.void",
        *[f"n.{f}" for f in more]) for more in ([], ["depth", "parent_start"])]
    texts = _node_rows(src, False, ["start", "text", "kind", "depth", "parent_start"]).select(
        "page_id", F.col("n.start").alias("pos"), F.col("n.start").alias("tidx"), "n.text", "n.kind", "n.depth", "n.parent_start")
    return Dom(tokenize(pages, arrays=sources), elements, texts, arrays.select("page_id", "txt"), base, arrays, sources,
               _bare(pages, id_col, html_col) if spread else src)


def asked_of(dom: Dom, asked: Asked) -> DataFrame:
    """``(page_id, els, texts)``, one row per page, with what is asked for."""
    read = F.arrow_udf(_in_batches(asked.read), asked.type).asNondeterministic()
    return dom.html.select("page_id", read("html").alias("p")).select("page_id", "p.els", "p.texts")


def exploded(df: DataFrame, array: str, name: str, keep: tuple = ("page_id",)) -> DataFrame:
    """``explode`` of an array of structs without nulls, whose column is evaluated once: the filter that
    Spark derives from ``explode`` (the array is not empty) would evaluate it a second time."""
    return df.select(*keep, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())


def page_texts(tokens: DataFrame) -> DataFrame:
    """Per page, the text of every token position (NULL for markup), so
    ``txt[pos + 1]`` is the text at ``pos``; bounded by one html value."""
    return tokens.groupBy("page_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]).alias("txt"))


def with_text_parts(sel: DataFrame, dom: Dom, col: str = "parts", first_only: bool = False) -> DataFrame:
    """Add the element's descendant text nodes (``*::text``), in order.

    ``sel`` must carry ``page_id, start_tc, end_tc``.  The page text array is
    joined 1:1 on ``page_id`` and sliced, so the cost is proportional to the
    output, not to elements x texts.
    """
    pt = dom.page_texts()
    n = F.col("end_tc") - F.col("start_tc") - 1
    parts = F.filter(F.slice("txt", F.col("start_tc") + 2, F.greatest(n, F.lit(0))), lambda x: x.isNotNull())
    parts = F.when(n > 0, parts if not first_only else F.slice(parts, 1, 1)) \
        .otherwise(F.array().cast("array<string>"))
    return sel.join(pt, "page_id", "left").withColumn(col, F.coalesce(parts, F.array().cast("array<string>"))) \
        .drop("txt")


def own_texts(dom: Dom) -> DataFrame:
    """Text nodes keyed by their parent element (``E::text``)."""
    return dom.texts.select("page_id", F.col("parent_start").alias("start"), "pos", "tidx", "text")
