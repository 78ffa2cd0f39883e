"""A page as one row: its tree in arrays, read by higher-order functions.

``encode`` gives ``(page_id, nodes, txt)``, and the source of every token where markup is asked for: ``nodes`` lists elements and text nodes in
document order, each with the start of its parent element.  What is asked of a page is then an expression over that row: a selector is a
filter of the elements, the text of an element a slice of ``txt``.  There is no join,
sort or exchange after the encoding, however many rules or parts are asked for, and a
page without tokens is a row with empty arrays.

Selectors of all rules form a trie of steps, so rules that begin alike share the matches
of their common steps.  ``let`` binds an array to a name: an expression used inside a
lambda would be evaluated again for every element.

A step that follows another costs (candidates x matches of the step before) in its page;
everything else is linear in the page, which is one value of the input.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webrel.operators import dom as D
from webrel.operators.select import Selector, Simple, parse_any, simple_pred


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def encode(dom: D.Dom, markup: bool = False) -> DataFrame:
    """``(page_id, nodes, txt)``, with ``markup`` also ``toks``, one row per page that was parsed.  A node is
    ``struct<start, end, tag, attrs, void, text, parent, ...>`` (``dom.NODE``); ``tag`` is null for text."""
    return dom.sources.select("page_id", "nodes", "txt", "toks") if markup else dom.arrays.select("page_id", "nodes", "txt")


class Page:
    """The arrays of a page inside an expression (see ``on_page``, ``asked_on_page``)."""

    def __init__(self, els: Column, texts: Column, txt: Column | None = None, toks: Column | None = None, asked: D.Asked | None = None):
        self._els, self._texts, self.txt, self.toks = els, texts, txt, toks
        self.asked, self.narrow = asked or D.Asked(), asked is not None

    @property
    def els(self) -> Column:
        """All elements; ``tagged`` and ``select`` ask for some only."""
        self.asked.elements = self.asked.parents = True
        return self._els

    @property
    def texts(self) -> Column:
        """All texts."""
        self.asked.texts = True
        return self._texts

    def tagged(self, *tags: str) -> Column:
        """Elements with one of the tags."""
        self.asked.conditions |= {(t, ()) for t in tags}
        return F.filter(self._els, lambda e: e["tag"].isin(*tags))

    def with_attr(self, *names: str) -> Column:
        """Elements with one of the attributes."""
        self.asked.conditions |= {(None, ((n, ""),)) for n in names}
        return F.filter(self._els, lambda e: reduce(Column.__or__, [e["attrs"][n].isNotNull() for n in names]))

    def deep(self, e: Column) -> Column:
        """Texts inside an element, in order."""
        if self.narrow:
            inside = F.slice(self._texts, e["text_at"] + 1, e["n_texts"])
            return F.transform(inside, lambda t: t["text"]) if self.asked.placed else inside
        return F.filter(F.slice(self.txt, e["start"] + 2, F.greatest(e["end"] - e["start"] - 1, F.lit(0))), lambda t: t.isNotNull())

    def own(self, e: Column) -> Column:
        """Texts right under an element."""
        self.asked.own = True
        if self.narrow:
            inside = F.slice(self._texts, e["text_at"] + 1, e["n_texts"])
            return F.transform(F.filter(inside, lambda t: t["parent"] == e["start"]), lambda t: t["text"])
        return F.transform(F.filter(self.texts, lambda t: t["parent"] == e["start"]), lambda t: t["text"])

    def markup(self, e: Column) -> Column:
        """Source of an element, with its end tag where it has one."""
        source = F.transform(F.slice(self.toks, e["start"] + 1, F.greatest(e["end"] - e["start"], F.lit(1))), lambda t: t["tok"])
        close = F.get(self.toks, e["end"])["tok"]
        closed = ~e["void"] & F.coalesce(F.regexp_replace(F.lower(close), r"\s+", "") == F.concat(F.lit("</"), e["tag"], F.lit(">")), F.lit(False))
        return F.concat(F.array_join(source, ""), F.when(closed, close).otherwise(F.lit("")))

    def _position(self, e: Column, s: Simple) -> Column:
        p = F.lit(True)
        self.asked.positions |= bool(s.pseudo)
        for name, n in s.pseudo:
            if name == "last-child":
                p = p & ~F.exists(self.els, lambda x: x["parent"].eqNullSafe(e["parent"]) & (x["start"] > e["start"]))
            else:
                p = p & (e["nth_of_type" if name == "nth-of-type" else "nth"] == (1 if name == "first-child" else n))
        return p

    def _follows(self, e: Column, comb: str, prev: Column) -> Column:
        if comb == " ":
            return F.exists(prev, lambda a: (a["start"] < e["start"]) & (e["start"] < a["end"]))
        self.asked.parents = True
        if comb == ">":
            return F.exists(prev, lambda a: a["start"] == e["parent"])
        before = lambda a: a["parent"].eqNullSafe(e["parent"]) & (a["start"] < e["start"])
        if comb == "~":
            return F.exists(prev, before)
        return F.exists(prev, lambda a: before(a) & ~F.exists(self.els, lambda x: before(x) & (x["start"] > a["start"])))

    def _hit(self, e: Column, comb: str, s: Simple, prev: Column | None) -> Column:
        p = simple_pred(s, lambda n: e[n])
        if s.own_text_contains is not None:
            p = p & F.coalesce(F.get(self.own(e), F.lit(0)).contains(s.own_text_contains), F.lit(False))
        p = p & self._position(e, s)
        return p if prev is None else p & self._follows(e, comb, prev)

    def _ask(self, s: Simple) -> None:
        """Of the conditions of a step what a value must hold: every operator asks for a part of it."""
        pairs = [("id", i) for i in s.ids] + [("class", c) for c in s.classes] + [(name, val or "") for name, _, val in s.attrs]
        self.asked.conditions.add((s.tag, tuple(pairs)))

    def step(self, comb: str, s: Simple, prev: Column | None) -> Column:
        """Elements that match a step and stand to those of the step before as ``comb`` says."""
        self._ask(s)
        return F.filter(self._els, lambda e: self._hit(e, comb, s, prev))

    def select(self, selector: str | Selector) -> Column:
        """The elements that match a selector, in document order."""
        sel = parse_any(selector) if isinstance(selector, str) else selector

        def chain(steps, prev):
            (comb, s), rest = steps[0], steps[1:]
            found = self.step(comb, s, prev)
            return found if not rest else let(found, lambda m: chain(rest, m))

        if len(sel.chains) == 1:
            return chain(sel.chains[0], None)
        if all(len(c) == 1 for c in sel.chains):
            for c in sel.chains:
                self._ask(c[0][1])
            return F.filter(self._els, lambda e: reduce(Column.__or__, [self._hit(e, *c[0], None) for c in sel.chains]))
        starts = F.flatten(F.array(*[F.transform(chain(c, None), lambda e: e["start"]) for c in sel.chains]))
        return let(starts, lambda st: F.filter(self._els, lambda e: F.array_contains(st, e["start"])))


def on_page(body: Callable[[Page], Column], markup: bool = False) -> Column:
    """An expression over the columns of ``encode``, whose arrays are evaluated once."""
    return let(F.struct("nodes", "txt", *(["toks"] if markup else [])), lambda p: let(F.filter(p["nodes"], lambda n: n["tag"].isNotNull()), lambda els: let(
        F.filter(p["nodes"], lambda n: n["tag"].isNull()), lambda texts: body(Page(els, texts, p["txt"], p["toks"] if markup else None)))))


def asked_on_page(dom: D.Dom, body: Callable[[Page], Column]) -> DataFrame:
    """``(page_id, r)``: an expression of a page's arrays, one row per page.  It is built twice: first to learn which elements and
    texts it asks for (``D.Asked``), then over the arrays of just these.  The conditions of the expression itself stay
    exact; the reading leaves out only what cannot meet any of them."""
    asked = D.Asked()
    body(Page(F.col("els"), F.col("texts"), asked=asked))
    found = let(F.struct("els", "texts"), lambda p: let(p["els"], lambda els: let(p["texts"], lambda texts: body(Page(els, texts, asked=asked)))))
    return D.asked_of(dom, asked).select("page_id", found.alias("r"))


# --- rules -------------------------------------------------------------------

class _Step:
    """A step of the trie: the rules that end here and the steps that go on."""

    def __init__(self):
        self.rules: list[int] = []
        self.next: dict[str, tuple[str, Simple, _Step]] = {}


def rule_items(dom: D.Dom, selectors: dict[int, Selector]) -> DataFrame:
    """``page_id, rule_id, pos, value``: every item of every rule, from one reading of each page.
    ``pos`` orders the items of a rule."""
    root = _Step()
    for i, sel in selectors.items():
        for chain in sel.chains:
            at = root
            for k, (comb, s) in enumerate(chain):
                comb = comb if k else " "
                at = at.next.setdefault(f"{comb}{s!r}", (comb, s, _Step()))[2]
            at.rules.append(i)

    def item(i: int, at: Column, k: Column, value: Column) -> Column:
        return F.struct(F.lit(i).alias("rule_id"), F.struct(at.cast("int").alias("at"), k.cast("int").alias("k")).alias("pos"), value.alias("value"))

    def items_of(p: Page, i: int, found: Column) -> Column:
        sel, zero = selectors[i], F.lit(0)
        if sel.pseudo_element == "text":
            own = F.filter(p.texts, lambda t: F.exists(found, lambda e: e["start"] == t["parent"]))
            return F.transform(own, lambda t: item(i, t["start"], zero, t["text"]))
        if sel.pseudo_element == "alltext":
            return F.flatten(F.transform(found, lambda e: F.transform(p.deep(e), lambda t, k: item(i, e["start"], k, t))))
        value = (lambda e: e["attrs"][sel.attr]) if sel.pseudo_element == "attr" else p.markup
        return F.filter(F.transform(found, lambda e: item(i, e["start"], zero, value(e))), lambda x: x["value"].isNotNull())

    def numbered(p: Page, i: int, found: Column) -> Column:
        """All items, or the n-th one of ``(//t)[n]``, which has one chain of steps."""
        return F.slice(items_of(p, i, found), selectors[i].index, 1) if selectors[i].index else items_of(p, i, found)

    def walk(p: Page, node: _Step, prev: Column | None) -> list[Column]:
        def onwards(n: _Step) -> Callable[[Column], Column]:
            return lambda m: F.flatten(F.array(*[numbered(p, i, m) for i in n.rules], *walk(p, n, m)))

        return [let(p.step(comb, s, prev), onwards(n)) for comb, s, n in node.next.values()]

    markup = any(sel.pseudo_element not in ("text", "alltext", "attr") for sel in selectors.values())
    found = on_page(lambda p: F.array_sort(F.array_distinct(F.flatten(F.array(*walk(p, root, None))))), markup)
    out = encode(dom, markup).select("page_id", F.explode(found).alias("i")).select("page_id", "i.rule_id", "i.pos", "i.value")
    return out
