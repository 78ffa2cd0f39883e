"""Rule-driven extraction.

A rule is ``{field, selector, multiple, regex, attr}`` (CSS or the XPath forms
of ``select.parse_xpath``).  All rules of a profile are read from the
page's arrays (``tree``) in one expression, in which rules that begin alike share
their first steps: no join and no exchange per rule.  Output is long form
``(page_id, field, idx, value)``; ``wide`` pivots over the known field list.

Rules are configuration (a profile file), compiled on the driver.  An item's
``pos`` is the struct (token of the element or text, number within it).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webrel.functions import text as TX
from webrel.operators import dom as D
from webrel.operators import page as P
from webrel.operators import tree as T
from webrel.operators.select import parse_any, simple_pred

def _as_list(rules) -> list[dict]:
    if isinstance(rules, DataFrame):
        rules = [r.asDict() for r in rules.collect()]
    out = []
    for r in rules:
        out.append({"field": r.get("field") or "data", "selector": r.get("selector") or "",
                    "multiple": bool(r.get("multiple")), "regex": r.get("regex"), "attr": r.get("attr")})
    return out


def items(dom: D.Dom, rules) -> DataFrame:
    """Every item of every rule: (page_id, rule_id, pos, value), ``pos`` in document order."""
    kinds = {}
    for i, r in enumerate(_as_list(rules)):
        if r["selector"]:
            kinds[i] = sel = parse_any(r["selector"])
            if r["attr"]:
                sel.pseudo_element, sel.attr = "attr", r["attr"].lower()
    if not kinds:
        return dom.elements.sparkSession.createDataFrame([], "page_id bigint, rule_id int, pos struct<at:int,k:int>, value string")
    return T.rule_items(dom, kinds)


def extract(dom: D.Dom, rules) -> DataFrame:
    """Long form ``(page_id, field, idx, value)``.

    single rule: first item, then the regex (group 0) - no match gives no row
    (NULL in the wide form); multiple: every item that matches, replaced by
    group 0; a later rule with the same field replaces an earlier one.
    """
    rules = _as_list(rules)
    last = {r["field"]: i for i, r in enumerate(rules)}
    keep = {i: rules[i] for i in last.values()}
    if not keep:
        return items(dom, rules).select("page_id", F.lit("").alias("field"), F.lit(0).alias("idx"), "value")

    def of(key: str) -> Column:
        return F.create_map(*[F.lit(x) for i, r in keep.items() for x in (i, r[key] if r[key] is not None else "")])[F.col("rule_id")]

    it = items(dom, rules).withColumns({"field": of("field"), "multiple": of("multiple"), "regex": of("regex")}).filter("field is not null")
    w = Window.partitionBy("page_id", "rule_id").orderBy("pos")
    it = it.withColumn("_n", F.row_number().over(w)).filter(F.col("multiple") | (F.col("_n") == 1))
    # user patterns are Python regexes: Unicode \w \d \s
    rx = F.concat(F.lit("(?U)"), F.col("regex"))
    it = it.withColumn("value", F.when(F.col("regex") == "", F.col("value")).otherwise(F.regexp_substr(F.col("value"), rx)))
    return it.filter(F.col("value").isNotNull()).withColumn("idx", F.row_number().over(w) - 1).select("page_id", "field", "idx", "value")


def wide(long: DataFrame, pages: DataFrame, fields: list[str], multiple: dict[str, bool]) -> DataFrame:
    """Long form -> one row per page, one column per field (scalar or array)."""
    aggs = []
    for f in fields:
        v = F.when(F.col("field") == f, F.struct("idx", "value"))
        if multiple.get(f):
            aggs.append(F.transform(F.array_sort(F.collect_list(v)), lambda s: s["value"]).alias(f))
        else:
            aggs.append(F.min_by(F.when(F.col("field") == f, F.col("value")),
                                 F.when(F.col("field") == f, F.col("idx"))).alias(f))
    g = long.groupBy("page_id").agg(*aggs)
    return pages.select("page_id").join(g, "page_id", "left")


def spider_items(dom: D.Dom, fields: dict[str, str] | None = None) -> DataFrame:
    """Per page and field the ``getall()`` values (multiple/regex/attr are
    ignored); ``value`` is the scalar when exactly one value, else NULL and
    ``values`` holds the list.  No fields -> ``{text: *::text}``."""
    fields = fields or {"text": "*::text"}
    rules = [{"field": k, "selector": v, "multiple": True} for k, v in fields.items()]
    long = extract(dom, rules)
    g = long.groupBy("page_id", "field").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("idx", "value"))), lambda s: s["value"]).alias("values"))
    return g.withColumn("value", F.when(F.size("values") == 1, F.try_element_at("values", F.lit(1))))


def find_by_text(dom: D.Dom, text: str, tag: str | None = None) -> DataFrame:
    """Elements whose own text contains ``text`` -> their first text node."""
    own = P.own_parts(dom, dom.elements.select("page_id", "start", "tag"))
    own = own.filter(F.exists("parts", lambda t: t.contains(text)))
    if tag and tag != "*":
        own = own.filter(F.col("tag") == tag)
    return own.select("page_id", "start", "tag", F.coalesce(F.try_element_at("parts", F.lit(1)), F.lit("")).alias("text"))


def selector_for(dom: D.Dom, text: str) -> DataFrame:
    """Selector of the first element whose own text contains ``text``; one row per page that
    has one.  Of the steps ``tag:nth-of-type(n) > ...`` from the root to it, the fewest last
    ones are taken that no other element of the page ends in, so D05 finds it alone."""
    def chosen(p: T.Page) -> Column:
        def shortest(path: Column, paths: Column) -> Column:
            last = lambda q, k: F.slice(q, F.greatest(F.size(q) - k + 1, F.lit(1)), k)
            alone = F.filter(F.sequence(F.lit(1), F.size(path)), lambda k: F.size(F.filter(paths, lambda q: last(q, k) == last(path, k))) == 1)
            return F.array_join(last(path, F.coalesce(F.get(alone, F.lit(0)), F.size(path))), " > ")

        def path_of(e: Column) -> Column:
            around = F.filter(p.els, lambda x: (x["start"] == e["start"]) | ((x["start"] < e["start"]) & (e["start"] < x["end"])))
            return F.transform(around, lambda x: F.concat(x["tag"], F.lit(":nth-of-type("), x["nth_of_type"].cast("string"), F.lit(")")))

        def selector(t: Column) -> Column:
            # only paths that end in the same step can end in more of them
            rivals = F.filter(p.els, lambda e: (e["tag"] == t["tag"]) & (e["nth_of_type"] == t["nth_of_type"]))
            return T.let(path_of(t), lambda path: T.let(F.transform(rivals, path_of), lambda paths: shortest(path, paths)))

        holder = F.array_min(F.transform(F.filter(p.texts, lambda t: t["text"].contains(text)), lambda t: t["parent"]))
        target = T.let(holder, lambda at: F.get(F.filter(p.els, lambda e: e["start"] == at), F.lit(0)))
        return T.let(target, lambda t: F.when(t.isNotNull(), F.struct(selector(t).alias("selector"))))

    found = T.encode(dom).select("page_id", F.array(T.on_page(chosen)).alias("s"))
    return D.exploded(found, "s", "s").select("page_id", "s.selector")


def preview(long: DataFrame, n: int = 120) -> DataFrame:
    """Values cut at ``n`` characters with '...'."""
    return long.withColumn("value", TX.preview(F.col("value"), n))


def display(df: DataFrame, rows: int = 10, record: bool = False) -> DataFrame:
    """First ``rows`` rows as text; values cut at 200 characters for one record, at 150 in a list."""
    width = 200 if record else 150
    text = lambda f: F.col(f.name).cast("string") if f.dataType.typeName() in ("string", "integer", "long", "double", "boolean") \
        else F.to_json(F.col(f.name)) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f.name).cast("string")
    return df.limit(rows).select(*[TX.cut(F.coalesce(text(f), F.lit("")), width).alias(f.name) for f in df.schema.fields])


def adhoc(dom: D.Dom, css: str | None = None, xpath: str | None = None, n_text: int = 20) -> dict[str, DataFrame]:
    """``css`` beats ``xpath``; neither -> meta + links + first
    ``n_text`` text nodes of each page (the cut is the feature)."""
    sel = css or xpath
    if sel:
        it = items(dom, [{"field": "match", "selector": sel, "multiple": True}])
        return {"matches": it.select("page_id", "pos.at", "pos.k", "value")}
    w = Window.partitionBy("page_id").orderBy("pos")
    txt = dom.texts.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n_text).drop("_n")
    return {"meta": P.page_meta(dom), "links": P.links_first_text(dom), "text": txt.select("page_id", "pos", "text")}


def scrape(dom: D.Dom, rules=None, meta=False, links=False, images=False, tables=False, text=False) -> dict:
    """Outputs chosen by flags; no rules and no flag -> meta + text."""
    out = {}
    if rules:
        out["rules"] = extract(dom, rules)
    if not rules and not any([meta, links, images, tables, text]):
        meta = text = True
    if meta:
        out["meta"] = P.page_meta(dom)
    if links:
        out["links"] = P.links_first_text(dom)
    if images:
        out["images"] = P.images_basic(dom)
    if tables:
        out["tables"] = P.table_rows_basic(dom)
    if text:
        out["text"] = P.page_text(dom)
    return out


__all__ = ["items", "extract", "wide", "spider_items", "find_by_text", "selector_for", "preview", "display",
           "adhoc", "scrape", "simple_pred"]
