"""The selector forms the extraction code uses, as Column
predicates over the ``elements`` relation.

Supported CSS: ``tag``, ``*``, ``.cls``, ``#id``, ``[a]``, ``[a=v]``, ``[a*=v]``,
``[a^=v]``, ``[a$=v]``, ``[a~=v]``, compounds, descendant (space), child
(``>``), comma union, ``:first-child``, ``:last-child``, ``:nth-child(n)``,
``:nth-of-type(n)`` and the pseudo-elements ``::text`` / ``::attr(name)``.
XPath: ``//t``, ``//t/text()``, ``//t//text()``, ``//t/@a``,
``//t[@a="v"]``, ``//t[contains(@a,"v")]``, ``//t[contains(text(),"v")]``,
``//t[n]`` and ``(//t)[n]``.

Evaluation is window-based: "X has an ancestor matching A" is
``max(end of A elements that start before X) > X.start`` over the page in
document order, so a descendant step costs one running aggregate and no
join.  Only the child combinator joins (on ``parent_start``).
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass
class Simple:
    tag: str | None = None
    ids: list[str] = field(default_factory=list)
    classes: list[str] = field(default_factory=list)
    attrs: list[tuple[str, str | None, str | None]] = field(default_factory=list)
    pseudo: list[tuple[str, int | None]] = field(default_factory=list)
    own_text_contains: str | None = None


@dataclass
class Selector:
    chains: list[list[tuple[str, Simple]]]   # comma union of (combinator, step)
    pseudo_element: str | None = None        # None | "text" | "alltext" | "attr"
    attr: str | None = None
    index: int | None = None                 # (//t)[n]: n-th match in the page


_SIMPLE_TOKEN = re.compile(
    r"""\s*(>|\+|~(?!=)|,)\s*|(\s+)|([a-zA-Z*][\w-]*)|\.([\w-]+)|\#([\w-]+)"""
    r"""|\[\s*([\w:-]+)\s*(?:([*^$~|]?=)\s*(?:"([^"]*)"|'([^']*)'|([^\]\s]*)))?\s*\]"""
    r"""|::(text|attr\(\s*([\w:-]+)\s*\))|:(first-child|last-child|nth-child|nth-of-type)(?:\((\d+)\))?""")


def parse_css(sel: str) -> Selector:
    sel = sel.strip()
    chains: list[list[tuple[str, Simple]]] = [[]]
    pe, pe_attr = None, None
    comb, cur = " ", None
    pos = 0
    while pos < len(sel):
        m = _SIMPLE_TOKEN.match(sel, pos)
        if not m or m.end() == pos:
            raise ValueError(f"unsupported selector: {sel!r} at {pos}")
        pos = m.end()
        g = m.groups()
        if g[0] is not None or g[1] is not None:
            c = g[0] if g[0] is not None else " "
            if pos >= len(sel):
                break
            if c == ",":
                chains.append([])
                comb, cur = " ", None
            else:
                comb, cur = c, None
            continue
        if cur is None:
            cur = Simple()
            chains[-1].append((comb, cur))
        if g[2] is not None:
            cur.tag = None if g[2] == "*" else g[2].lower()
        elif g[3] is not None:
            cur.classes.append(g[3])
        elif g[4] is not None:
            cur.ids.append(g[4])
        elif g[5] is not None:
            val = next((v for v in (g[7], g[8], g[9]) if v is not None), None)
            cur.attrs.append((g[5].lower(), g[6], val))
        elif g[10] is not None:
            if g[10] == "text":
                pe = "text"
            else:
                pe, pe_attr = "attr", g[11].lower()
        elif g[12] is not None:
            cur.pseudo.append((g[12], int(g[13]) if g[13] else None))
    for ch in chains:
        if not ch:  # bare "::text" / "::attr(x)" = any element
            ch.append((" ", Simple()))
    return Selector(chains, pe, pe_attr)


_XP_STEP = re.compile(
    r"""^(//|/)([a-zA-Z*][\w-]*)(?:\[(?:@([\w:-]+)\s*=\s*["']([^"']*)["']"""
    r"""|contains\(\s*@([\w:-]+)\s*,\s*["']([^"']*)["']\s*\)"""
    r"""|contains\(\s*text\(\)\s*,\s*["']([^"']*)["']\s*\)|(\d+))\])?""")


def parse_xpath(xp: str) -> Selector:
    xp = xp.strip()
    index = None
    m = re.match(r"^\((.*)\)\[(\d+)\]$", xp)
    if m:
        xp, index = m.group(1), int(m.group(2))
    pe, attr = None, None
    if xp.endswith("//text()"):
        pe, xp = "alltext", xp[: -len("//text()")]
    elif xp.endswith("/text()"):
        pe, xp = "text", xp[: -len("/text()")]
    else:
        m = re.search(r"/@([\w:-]+)$", xp)
        if m:
            pe, attr, xp = "attr", m.group(1).lower(), xp[: m.start()]
    chain: list[tuple[str, Simple]] = []
    while xp:
        m = _XP_STEP.match(xp)
        if not m:
            raise ValueError(f"unsupported xpath: {xp!r}")
        s = Simple(tag=None if m.group(2) == "*" else m.group(2).lower())
        if m.group(3):
            s.attrs.append((m.group(3).lower(), "=", m.group(4)))
        if m.group(5):
            s.attrs.append((m.group(5).lower(), "*=", m.group(6)))
        if m.group(7) is not None:
            s.own_text_contains = m.group(7)
        if m.group(8):
            s.pseudo.append(("nth-of-type", int(m.group(8))))
        chain.append((" " if m.group(1) == "//" else ">", s))
        xp = xp[m.end():]
    if chain and chain[0][0] == ">":
        chain[0] = (" ", chain[0][1])
    return Selector([chain], pe, attr, index)


def parse_any(sel: str) -> Selector:
    s = sel.strip()
    if s.startswith("//") or s.startswith("(//"):
        return parse_xpath(s)
    return parse_css(s)


def _attr_pred(a: Column, op: str | None, val: str | None) -> Column:
    if op is None:
        return a.isNotNull()
    if op == "=":
        return a == val
    if op == "*=":
        return a.contains(val) if val else F.lit(False)
    if op == "^=":
        return a.startswith(val) if val else F.lit(False)
    if op == "$=":
        return a.endswith(val) if val else F.lit(False)
    if op == "~=":
        return F.array_contains(F.split(a, r"\s+"), val)
    if op == "|=":
        return (a == val) | a.startswith(val + "-")
    raise ValueError(op)


def simple_pred(s: Simple, of: Callable[[str], Column] = F.col) -> Column:
    """Tag, id, class and attribute conditions on an element whose fields ``of`` gives."""
    p = F.lit(True)
    if s.tag:
        p = p & (of("tag") == s.tag)
    for i in s.ids:
        p = p & (of("attrs")["id"] == i)
    for c in s.classes:
        p = p & F.coalesce(F.array_contains(F.split(F.trim(of("attrs")["class"]), r"\s+"), c), F.lit(False))
    for a in s.attrs:
        p = p & F.coalesce(_attr_pred(of("attrs")[a[0]], *a[1:]), F.lit(False))
    return p


def _needs_position(s: Simple) -> bool:
    return bool(s.pseudo)


def _position_pred(s: Simple) -> Column:
    p = F.lit(True)
    for name, n in s.pseudo:
        if name == "first-child":
            p = p & (F.col("_child_no") == 1)
        elif name == "last-child":
            p = p & (F.col("_child_rev") == 1)
        elif name == "nth-child":
            p = p & (F.col("_child_no") == n)
        elif name == "nth-of-type":
            p = p & (F.col("_type_no") == n)
    return p


def with_positions(elements: DataFrame) -> DataFrame:
    """Sibling numbers: position among element children / same-tag children."""
    w = Window.partitionBy("page_id", "parent_start").orderBy("start")
    wr = Window.partitionBy("page_id", "parent_start").orderBy(F.col("start").desc())
    wt = Window.partitionBy("page_id", "parent_start", "tag").orderBy("start")
    return (elements.withColumn("_child_no", F.row_number().over(w))
            .withColumn("_child_rev", F.row_number().over(wr))
            .withColumn("_type_no", F.row_number().over(wt)))


def inside(flag: str) -> Column:
    """True when some element flagged ``flag`` strictly contains this one."""
    w = Window.partitionBy("page_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.max(F.when(F.col(flag), F.col("end"))).over(w) > F.col("start"), F.lit(False))


def flag(elements: DataFrame, selector: str | Selector, name: str, own_texts: DataFrame | None = None) -> DataFrame:
    """Add boolean column ``name``: the element matches ``selector``."""
    sel = parse_any(selector) if isinstance(selector, str) else selector
    df = elements
    if any(_needs_position(s) for ch in sel.chains for _, s in ch) and "_child_no" not in df.columns:
        df = with_positions(df)
    if any(s.own_text_contains for ch in sel.chains for _, s in ch):
        if own_texts is None:
            raise ValueError("contains(text(), ...) needs own_texts")
    chain_cols = []
    for ci, chain in enumerate(sel.chains):
        prev = None
        for si, (comb, s) in enumerate(chain):
            col = f"_{name}_{ci}_{si}"
            pred = simple_pred(s) & _position_pred(s)
            if s.own_text_contains is not None:
                hit = (own_texts.filter(F.col("text").contains(s.own_text_contains))
                       .select("page_id", "start").distinct().withColumn(col + "_t", F.lit(True)))
                df = df.join(hit, ["page_id", "start"], "left")
                pred = pred & F.coalesce(F.col(col + "_t"), F.lit(False))
            if prev is None:
                df = df.withColumn(col, pred)
            elif comb == " ":
                df = df.withColumn(col, pred & inside(prev))
            elif comb == ">":
                par = df.filter(F.col(prev)).select("page_id", F.col("start").alias("parent_start"),
                                                    F.lit(True).alias(col + "_p"))
                df = df.join(par, ["page_id", "parent_start"], "left")
                df = df.withColumn(col, pred & F.coalesce(F.col(col + "_p"), F.lit(False)))
            else:  # siblings: "+" the element right before, "~" any before
                ws = Window.partitionBy("page_id", "parent_start").orderBy("start")
                before = (F.lag(F.col(prev)).over(ws) if comb == "+" else
                          F.max(F.col(prev)).over(ws.rowsBetween(Window.unboundedPreceding, -1)))
                df = df.withColumn(col, pred & F.coalesce(before, F.lit(False)))
            prev = col
        chain_cols.append(prev)
    out = F.lit(False)
    for c in chain_cols:
        out = out | F.col(c)
    df = df.withColumn(name, out)
    return df.drop(*[c for c in df.columns if c.startswith(f"_{name}_")])


def first_matches(elements: DataFrame, scope_flag: str, targets: dict[str, str]) -> DataFrame:
    """Several D08 lookups over ONE window sort: ``targets`` maps a target flag
    column to its output column."""
    w = (Window.partitionBy("page_id").orderBy(F.col("start").desc())
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    df = elements.select("*", *[F.last(F.when(F.col(t), F.col("start")), ignorenulls=True).over(w).alias(o)
                                for t, o in targets.items()])
    limit = F.when(F.col("void"), F.col("start") + 1).otherwise(F.col("end"))
    return df.select(*[c for c in df.columns if c not in targets.values()],
                     *[F.when(F.col(scope_flag) & (F.col(o) < limit), F.col(o)).alias(o) for o in targets.values()])


def first_match(elements: DataFrame, scope_flag: str, target_flag: str, out: str) -> DataFrame:
    """For every element, the start of the first descendant-or-self element
    flagged ``target_flag`` (NULL when none); evaluated where ``scope_flag``."""
    w = (Window.partitionBy("page_id").orderBy(F.col("start").desc())
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    nxt = F.last(F.when(F.col(target_flag), F.col("start")), ignorenulls=True).over(w)
    df = elements.withColumn(out, nxt)
    return df.withColumn(out, F.when(F.col(scope_flag) & (F.col(out) < F.when(F.col("void"), F.col("start") + 1)
                                                         .otherwise(F.col("end"))), F.col(out)))


def nearest_ancestor(elements: DataFrame, flag_col: str, out: str) -> DataFrame:
    """``closest()`` for every element: start of the nearest strictly enclosing
    element flagged ``flag_col`` (NULL when none).

    Windows only, and the input is read once (each row carries itself through
    the explodes): a running count of open flagged elements gives each element
    the nesting level k of its nearest flagged ancestor, and that ancestor is
    the last flagged element started before it at level k (partition
    ``(page_id, level)``), the same two-role trick as parent computation."""
    f = F.coalesce(F.col(flag_col) & ~F.col("void"), F.lit(False))
    row = F.struct(*[F.col(c) for c in elements.columns]).alias("_row")
    ev = elements.select("page_id", "start", f.alias("_f"), row, F.explode(F.array(
        F.struct(F.col("start").alias("pos"), F.lit(1).alias("ord"), F.when(f, 1).otherwise(0).alias("d")),
        F.struct(F.col("end").alias("pos"), F.lit(0).alias("ord"), F.when(f, -1).otherwise(0).alias("d"))))
        .alias("e")).filter((F.col("e.ord") == 1) | F.col("_f"))
    w = Window.partitionBy("page_id").orderBy("e.pos", "e.ord").rowsBetween(Window.unboundedPreceding,
                                                                            Window.currentRow)
    ev = ev.withColumn("open", F.sum("e.d").over(w) - F.col("e.d")).filter(F.col("e.ord") == 1)
    roles = ev.select("page_id", "start", "_f", "open", "_row", F.explode(
        F.when(F.col("_f"), F.array(F.lit("p"), F.lit("c"))).otherwise(F.array(F.lit("c")))).alias("as"))
    roles = roles.withColumn("key", F.when(F.col("as") == "p", F.col("open")).otherwise(F.col("open") - 1))
    wk = (Window.partitionBy("page_id", "key").orderBy("start", F.col("as").desc())
          .rowsBetween(Window.unboundedPreceding, -1))
    anc = roles.withColumn(out, F.last(F.when(F.col("as") == "p", F.col("start")), True).over(wk))
    anc = anc.filter(F.col("as") == "c").select("_row.*", F.when(F.col("open") > 0, F.col(out)).alias(out))
    return anc
