"""The full record of a page (F14) and its parts as expressions over the page's arrays
(``tree``): every part is a filter and a slice, so a record takes one reading of the page.
Lists that have nothing are empty, as a page without tokens is a record with empty parts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webrel.functions.text import collapse_ws, join_strip, pystrip, strip_join
from webrel.operators import dom as D
from webrel.operators.tree import Page, asked_on_page, let

# --- fixed values -----------------------------------------------------------
# Social networks, tested in this order; the first that fits names the platform.
SOCIAL_PATTERNS = ["facebook", "twitter", "instagram", "linkedin", "youtube", "tiktok", "x.com"]
# Selectors of the full extractor.
SECTION_SEL = "section, article, main, [class*='section'], [class*='block']"
NAV_SEL = "nav a, header a, [class*='nav'] a, [class*='menu'] a"
BUTTON_SEL = "button, a[class*='btn'], a[class*='button'], [class*='cta']"
# ---------------------------------------------------------------------------

META = {"description": ("meta", "name", "description", "content"), "og_title": ("meta", "property", "og:title", "content"),
        "og_description": ("meta", "property", "og:description", "content"), "og_image": ("meta", "property", "og:image", "content"),
        "canonical": ("link", "rel", "canonical", "href")}


def text_or(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def first(a: Column) -> Column:
    return F.get(a, F.lit(0))


def tagged(p: Page, *tags: str) -> Column:
    return p.tagged(*tags)


def in_element(outer: Column, at: Column) -> Column:
    return (outer["start"] < at) & (at < outer["end"])


def first_within(e: Column, matches: Column) -> Column:
    """The first of ``matches`` that is ``e`` or lies inside it (null: none)."""
    till = F.when(e["void"], e["start"] + 1).otherwise(e["end"])
    return first(F.filter(matches, lambda x: (x["start"] >= e["start"]) & (x["start"] < till)))


def closest(at: Column, matches: Column) -> Column:
    """The last of ``matches`` that encloses a position (null: none)."""
    return F.try_element_at(F.filter(matches, lambda x: in_element(x, at)), F.lit(-1))


def inner_text(p: Page, e: Column) -> Column:
    """All text inside an element, stripped; null for none."""
    return pystrip(F.array_join(p.deep(e), ""))


def first_rows(options: list[Callable[[], Column]]) -> Column:
    """The first of several arrays that has rows; those after it are not evaluated."""
    if len(options) == 1:
        return options[0]()
    return let(options[0](), lambda found: F.when(F.size(found) > 0, found).otherwise(first_rows(options[1:])))


def title(p: Page) -> Column:
    """first text of the first ``title``, stripped ('' when absent)."""
    return text_or(pystrip(first(p.own(first(tagged(p, "title"))))))


def raw_title(p: Page) -> Column:
    return text_or(first(p.own(first(tagged(p, "title")))))


def meta(p: Page) -> dict[str, Column]:
    """Description, og tags and canonical link; missing ones are ''."""
    def one(tag: str, key: str, name: str, value: str) -> Column:
        e = first(F.filter(tagged(p, tag), lambda e: F.coalesce(e["attrs"][key] == name, F.lit(False))))
        return text_or(e["attrs"][value])

    return {k: one(*v) for k, v in META.items()}


def headings(p: Page) -> Column:
    """non-empty h1-h4 texts, by level, then in document order."""
    def of(level: str) -> Column:
        return F.transform(tagged(p, level), lambda e: F.struct(F.lit(level).alias("level"), strip_join(p.deep(e)).alias("text")))

    return F.filter(F.concat(*[of(f"h{k}") for k in (1, 2, 3, 4)]), lambda h: h["text"] != "")


def sections(p: Page) -> Column:
    """``start``, heading (first h1-h3 inside, or the element itself) and content (own texts of p,
    span and li inside, as ``pos, text``) of section-like elements with any content."""
    def of(e: Column, heads: Column, texts: Column) -> Column:
        till = F.when(e["void"], e["start"] + 1).otherwise(e["end"])
        head = first(F.filter(heads, lambda h: (h["start"] >= e["start"]) & (h["start"] < till)))
        inside = F.filter(texts, lambda t: (t["pos"] > e["start"]) & (t["pos"] <= e["end"]) & (t["parent"] >= e["start"]))
        return F.struct(e["start"].alias("start"), text_or(head["text"]).alias("heading"), inside.alias("content"))

    heads = F.transform(tagged(p, "h1", "h2", "h3"), lambda e: F.struct(e["start"].alias("start"), join_strip(p.deep(e)).alias("text")))
    holders = F.transform(tagged(p, "p", "span", "li"), lambda e: e["start"])
    texts = let(holders, lambda hs: F.filter(F.transform(F.filter(p.texts, lambda t: F.array_contains(hs, t["parent"])), lambda t: F.struct(
        t["start"].alias("pos"), t["parent"].alias("parent"), pystrip(t["text"]).alias("text"))), lambda t: t["text"] != ""))
    found = let(heads, lambda h: let(texts, lambda t: F.transform(p.select(SECTION_SEL), lambda e: of(e, h, t))))
    return F.filter(found, lambda s: F.size(s["content"]) > 0)


def paragraphs(p: Page, min_len: int = 20) -> Column:
    """own texts of ``p``, stripped, longer than ``min_len``."""
    holders = F.transform(tagged(p, "p"), lambda e: e["start"])
    texts = let(holders, lambda hs: F.filter(p.texts, lambda t: F.array_contains(hs, t["parent"])))
    return F.filter(F.transform(texts, lambda t: pystrip(t["text"])), lambda t: F.length(t) > min_len)


def _at(e: Column, at: bool) -> list[Column]:
    """The position of an element, for parts that are asked for with it."""
    return [e["start"].alias("start")] if at else []


def _anchors(p: Page, els: Column, at: bool) -> Column:
    some = F.filter(els, lambda e: text_or(e["attrs"]["href"]) != "")
    return F.transform(some, lambda e: F.struct(*_at(e, at), join_strip(p.deep(e)).alias("text"), e["attrs"]["href"].alias("href")))


def navigation(p: Page, at: bool = False) -> Column:
    """anchors of navigation areas with href and text."""
    return F.filter(_anchors(p, p.select(NAV_SEL), at), lambda a: a["text"] != "")


def links(p: Page, at: bool = False) -> Column:
    """anchors with href."""
    return _anchors(p, tagged(p, "a"), at)


def images(p: Page, lazy: tuple = ("data-src", "data-lazy-src"), at: bool = False) -> Column:
    """src, else a lazy source, and alt."""
    def of(e: Column) -> Column:
        src = F.coalesce(*[F.nullif(e["attrs"][a], F.lit("")) for a in ("src", *lazy)], F.lit(""))
        return F.struct(*_at(e, at), src.alias("src"), text_or(e["attrs"]["alt"]).alias("alt"))

    return F.filter(F.transform(tagged(p, "img"), of), lambda i: i["src"] != "")


def forms(p: Page, at: bool = False) -> Column:
    """action, method and the fields whose closest form it is."""
    def of(f: Column, all_forms: Column, fields: Column) -> Column:
        own = F.filter(fields, lambda x: F.element_at(F.filter(all_forms, lambda g: in_element(g, x["start"])), -1)["start"] == f["start"])
        return F.struct(
            *_at(f, at), text_or(f["attrs"]["action"]).alias("action"), F.coalesce(f["attrs"]["method"], F.lit("get")).alias("method"),
            F.transform(own, lambda x: F.struct(*_at(x, at), F.coalesce(x["attrs"]["type"], F.lit("text")).alias("type"), text_or(x["attrs"]["name"]).alias("name"),
                                                text_or(x["attrs"]["placeholder"]).alias("placeholder"))).alias("fields"))

    return let(tagged(p, "form"), lambda fs: let(
        F.filter(tagged(p, "input", "textarea", "select"), lambda x: F.exists(fs, lambda f: in_element(f, x["start"]))),
        lambda xs: F.transform(fs, lambda f: of(f, fs, xs))))


def buttons(p: Page, at: bool = False) -> Column:
    """buttons and calls to action with text."""
    found = F.transform(p.select(BUTTON_SEL), lambda e: F.struct(*_at(e, at), join_strip(p.deep(e)).alias("text"), text_or(e["attrs"]["href"]).alias("href")))
    return F.filter(found, lambda b: b["text"] != "")


def cells(p: Page, t: Column, tables: Column, tag: str) -> Column:
    """td or th elements whose closest table is ``t``."""
    inside = F.filter(tagged(p, tag), lambda e: in_element(t, e["start"]))
    return F.filter(inside, lambda e: ~F.exists(tables, lambda u: (u["start"] > t["start"]) & in_element(u, e["start"])))


def tables(p: Page) -> Column:
    """rows of each table as MAPs header -> text (``col_n`` without headers; shorter side decides; of
    equal headers the last cell counts)."""
    def row(heads: Column, values: Column) -> Column:
        n = F.when(F.size(heads) == 0, F.size(values)).otherwise(F.least(F.size(heads), F.size(values)))
        keys = F.transform(F.slice(values, 1, n), lambda v, i: F.coalesce(F.get(heads, i), F.concat(F.lit("col_"), i.cast("string"))))
        return let(keys, lambda ks: F.map_from_entries(F.filter(F.transform(ks, lambda k, i: F.when(
            F.array_position(ks, k) == i + 1, F.struct(k.alias("key"), F.get(values, F.size(ks) - F.array_position(F.reverse(ks), k).cast("int")).alias("value")))),
            lambda e: e.isNotNull())))

    def of(t: Column, all_tables: Column) -> Column:
        rows = F.filter(tagged(p, "tr"), lambda e: in_element(t, e["start"]))

        def assembled(heads: Column, tds: Column) -> Column:
            mine = lambda r: F.filter(tds, lambda c: F.element_at(F.filter(rows, lambda x: in_element(x, c["start"])), -1)["start"] == r["start"])
            filled = F.filter(F.transform(rows, lambda r: F.transform(mine(r), lambda c: join_strip(p.deep(c)))), lambda v: F.size(v) > 0)
            return F.transform(filled, lambda v: row(heads, v))

        heads = F.transform(cells(p, t, all_tables, "th"), lambda c: join_strip(p.deep(c)))
        in_row = F.filter(cells(p, t, all_tables, "td"), lambda c: F.exists(rows, lambda r: in_element(r, c["start"])))
        return F.struct(let(heads, lambda h: let(in_row, lambda d: assembled(h, d))).alias("rows"))

    found = let(tagged(p, "table"), lambda ts: F.transform(ts, lambda t: of(t, ts)))
    return F.filter(found, lambda t: F.size(t["rows"]) > 0)


def table_rows(p: Page, index: int | None = None) -> Column:
    """``table_start, row_no, col_no, header, value`` of the cells of each table (``index``: of the n-th one
    with rows).  Rows are ``tr`` with any td; the shorter of headers and cells decides; without headers ``header`` is null."""
    def of(t: Column, all_tables: Column) -> Column:
        def numbered(rows: Column, heads: Column) -> Column:
            n = lambda r: F.when(F.size(heads) == 0, F.size(r)).otherwise(F.least(F.size(r), F.size(heads)))
            return F.flatten(F.transform(rows, lambda r, k: F.transform(F.slice(r, 1, n(r)), lambda v, i: F.struct(
                t["start"].alias("table_start"), (k + 1).alias("row_no"), i.alias("col_no"), F.get(heads, i).alias("header"), v.alias("value")))))

        def filled(trs: Column, tds: Column) -> Column:
            mine = lambda r: F.filter(tds, lambda c: F.element_at(F.filter(trs, lambda x: in_element(x, c["start"])), -1)["start"] == r["start"])
            return F.filter(F.transform(trs, lambda r: F.transform(mine(r), lambda c: join_strip(p.deep(c)))), lambda v: F.size(v) > 0)

        trs = F.filter(tagged(p, "tr"), lambda e: in_element(t, e["start"]))
        heads = F.transform(cells(p, t, all_tables, "th"), lambda c: join_strip(p.deep(c)))
        return let(heads, lambda hs: let(trs, lambda rs: let(
            F.filter(cells(p, t, all_tables, "td"), lambda c: F.exists(rs, lambda r: in_element(r, c["start"]))),
            lambda ds: let(filled(rs, ds), lambda v: numbered(v, hs)))))

    found = let(tagged(p, "table"), lambda ts: F.filter(F.transform(ts, lambda t: of(t, ts)), lambda c: F.size(c) > 0))
    return F.flatten(found if index is None else F.slice(found, index, 1))


def table_rows_basic(p: Page, index: int | None = 1) -> Column:
    """First text of each cell of the ``index``-th table and those inside it (None: of all); the key is the header over it, or
    ``col_n`` in a row whose cell count differs from that of its table's headers."""
    def value(e: Column) -> Column:
        return text_or(pystrip(first(p.deep(e))))

    def of(t: Column, all_tables: Column) -> Column:
        def keyed(r: Column, rows: Column, heads: Column, tds: Column) -> Column:
            mine = F.filter(tds, lambda c: F.element_at(F.filter(rows, lambda x: in_element(x, c["start"])), -1)["start"] == r["start"])
            return let(mine, lambda cs: F.transform(cs, lambda c, i: F.struct(
                r["start"].alias("tr_start"), i.alias("col_no"), F.when(F.size(heads) == F.size(cs), F.get(heads, i)).otherwise(
                    F.concat(F.lit("col_"), i.cast("string"))).alias("key"), value(c).alias("value"))))

        rows = F.filter(tagged(p, "tr"), lambda e: in_element(t, e["start"]))
        tds = F.filter(cells(p, t, all_tables, "td"), lambda c: F.exists(tagged(p, "tr"), lambda r: in_element(t, r["start"]) & in_element(r, c["start"])))
        return let(rows, lambda rs: let(F.transform(cells(p, t, all_tables, "th"), value), lambda hs: let(
            tds, lambda ds: F.flatten(F.transform(rs, lambda r: keyed(r, rs, hs, ds))))))

    def chosen(ts: Column) -> Column:
        """The ``index``-th table that lies in no other, with the tables inside it."""
        outer = F.filter(ts, lambda t: ~F.exists(ts, lambda u: in_element(u, t["start"])))
        return let(F.get(outer, F.lit(index - 1)), lambda o: F.filter(ts, lambda t: (t["start"] >= o["start"]) & (t["start"] < o["end"])))

    return let(tagged(p, "table"), lambda ts: F.flatten(F.transform(chosen(ts) if index else ts, lambda t: of(t, ts))))


def platform(href: Column, mode: str = "host") -> Column:
    """the social network of a (lower-cased) link; null for others.  ``host``: the network's name is a
    label of the host, or the host ends in its domain; ``substring``: it occurs anywhere."""
    host = F.regexp_extract(href, r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    out = F.lit(None).cast("string")
    for name in reversed(SOCIAL_PATTERNS):
        if mode == "substring":
            hit = href.contains(name)
        elif "." in name:
            hit = (host == name) | host.endswith("." + name)
        else:
            hit = F.array_contains(F.split(host, r"\."), name)
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def social_links(p: Page, mode: str = "host", at: bool = False) -> Column:
    """anchors to social networks."""
    found = F.transform(tagged(p, "a"), lambda e: let(F.lower(text_or(e["attrs"]["href"])), lambda h: F.struct(
        *_at(e, at), platform(h, mode).alias("platform"), h.alias("href"), join_strip(p.deep(e)).alias("text"))))
    return F.filter(found, lambda a: a["platform"].isNotNull())


def full_text(p: Page) -> Column:
    """texts below the first body's children, stripped, joined, white space collapsed."""
    body = first(tagged(p, "body"))
    return let(body, lambda b: text_or(pystrip(collapse_ws(strip_join(F.transform(
        F.filter(p.texts, lambda t: in_element(b, t["start"]) & (t["parent"] != b["start"])), lambda t: t["text"]))))))


def json_blocks(p: Page) -> Column:
    """``start, body`` of the JSON-LD blocks that are not empty."""
    blocks = F.filter(tagged(p, "script"), lambda e: F.coalesce(e["attrs"]["type"] == "application/ld+json", F.lit(False)))
    return F.filter(F.transform(blocks, lambda e: F.struct(*_at(e, True), pystrip(text_or(first(p.deep(e)))).alias("body"))), lambda b: b["body"] != "")


def structured_data(p: Page) -> Column:
    """JSON-LD blocks that parse, as VARIANT values."""
    parsed = F.transform(json_blocks(p), lambda b: F.try_parse_json(b["body"]))
    return F.filter(parsed, lambda v: v.isNotNull())


PARTS = {
    "title": title, "structured_data": structured_data, "headings": headings,
    "sections": lambda p: F.transform(sections(p), lambda s: F.struct(s["heading"].alias("heading"), F.transform(
        s["content"], lambda t: t["text"]).alias("content"))),
    "paragraphs": paragraphs, "navigation": navigation, "links": links, "images": images, "forms": forms, "buttons_cta": buttons,
    "tables": tables, "social_links": social_links, "full_text": full_text,
}


def parts(dom: D.Dom, **of) -> DataFrame:
    """One row per page with a column for each part asked for; all of them from one reading."""
    record = asked_on_page(dom, lambda p: F.struct(*[part(p).alias(name) for name, part in of.items()]))
    return record.select("page_id", *[F.col("r")[name].alias(name) for name in of])


def rows(dom: D.Dom, part) -> DataFrame:
    """The rows of one part: ``page_id``, and the fields of its structs (``value`` for plain values)."""
    each = D.exploded(parts(dom, x=part), "x", "x")
    return each.select("page_id", "x.*") if each.schema["x"].dataType.typeName() == "struct" else each.withColumnRenamed("x", "value")


def extract_full(dom: D.Dom, social_mode: str = "host") -> DataFrame:
    """one record per page."""
    return parts(dom, **{**PARTS, "social_links": lambda p: social_links(p, social_mode)})
