"""Business-data extraction.

Every block type is "elements matching a class heuristic, with their text and
the text of the first descendant-or-self element matching a sub-selector": an
expression over the page's arrays (``tree``).  ``extract_business`` reads them all
from one reading of the page; the single operators give their rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webrel.functions import text as TX
from webrel.operators import dom as D
from webrel.operators import record as RC
from webrel.operators.record import first, in_element, text_or
from webrel.operators.tree import Page, let

# --- fixed values -----------------------------------------------------------
PRICE_SEL = "[class*='price'], [class*='plan'], [class*='pricing'], [id*='price'], [id*='plan']"
PRICE_LABEL_SEL = "h1, h2, h3, h4, [class*='title'], [class*='name']"
SERVICE_SEL = ("[class*='service'], [class*='feature'], [class*='product'], [class*='offering'], "
               "[class*='treatment'], [class*='program']")
TEAM_SEL = ("[class*='team'], [class*='staff'], [class*='member'], [class*='doctor'], "
            "[class*='therapist'], [class*='coach']")
TEAM_NAME_SEL = "h1, h2, h3, h4, [class*='name'], strong"
TEAM_ROLE_SEL = "[class*='role'], [class*='title'], [class*='position'], span"
TESTIMONIAL_SEL = "[class*='testimonial'], [class*='review'], [class*='quote'], [class*='feedback']"
AUTHOR_SEL = "[class*='author'], [class*='name'], cite, strong"
FAQ_SEL = "[class*='faq'], [class*='accordion'], details"
QUESTION_SEL = "summary, [class*='question'], h3, h4, dt, strong"
ANSWER_SEL = "[class*='answer'], p, dd"
LOCATION_SEL = "[class*='location'], [class*='address'], [class*='office'], address"
STAT_SEL = "[class*='stat'], [class*='count'], [class*='metric'], [class*='number'], [class*='achievement']"
STAT_NUMBER_SEL = "[class*='number'], [class*='count'], strong, span"
STAT_LABEL_SEL = "[class*='label'], [class*='title'], p, span"
# Cut lengths and thresholds.
LIMITS = {"price_label": 100, "price_text": 300, "fallback_label": 50, "fallback_text": 200,
          "service_min": 20, "service_name": 100, "service_desc": 300,
          "team_min": 10, "team_name": 80, "team_role": 80, "team_bio": 200,
          "testimonial_min": 20, "testimonial_text": 400, "testimonial_author": 80,
          "faq_q": 200, "faq_a": 400, "location_min": 10, "location_text": 200,
          "stat_number": 50, "stat_label": 100}
# ---------------------------------------------------------------------------


def dedupe_keep_first(df: DataFrame, key: str, order: str, by: list[str] | None = None) -> DataFrame:
    """First row per (``by`` + ``key``) in ``order``; rows with an empty key
    are all kept.  Written as one aggregation (partial aggregation absorbs a
    hot key) instead of a window over the key."""
    by = by or []
    cols = df.columns
    k = F.coalesce(F.col(key).cast("string"), F.lit(""))
    firsts = (df.filter(k != "").groupBy(*by, key)
              .agg(F.min_by(F.struct(*cols), F.col(order)).alias("_r")).select("_r.*"))
    return firsts.unionByName(df.filter(k == "").select(*cols))


def _text(p: Page, e: Column) -> Column:
    """Text of an element; '' for none."""
    return text_or(TX.strip_join(p.deep(e)))


def _blocks(p: Page, found: Column, subs: dict[str, str], row: Callable[[Column, dict[str, Column]], Column]) -> Column:
    """``row`` of every element of ``found`` with, by name, its first descendant-or-self element that
    matches each sub-selector (null: none)."""
    def bind(names: list[str], matches: dict[str, Column]) -> Column:
        if names:
            return let(p.select(subs[names[0]]), lambda m: bind(names[1:], {**matches, names[0]: m}))
        return F.transform(found, lambda e: row(e, {n: RC.first_within(e, m) for n, m in matches.items()}))

    return bind(list(subs), {})


def _keep_first(rows: Column, key: str) -> Column:
    """B12 within a page: the first row per key, and all rows with an empty one."""
    return let(rows, lambda rs: let(F.transform(rs, lambda r: r[key]), lambda ks: F.filter(
        rs, lambda r, i: (r[key] == "") | (F.array_position(ks, r[key]) == i + 1))))


def _class_id(e: Column) -> Column:
    return F.lower(F.concat(text_or(e["attrs"]["class"]), text_or(e["attrs"]["id"])))


def contact(p: Page) -> Column:
    """B01-B03 on ``" ".join(body *::text)``: e-mails, phones, hours."""
    parts = let(first(RC.tagged(p, "body")), lambda b: F.transform(
        F.filter(p.texts, lambda t: in_element(b, t["start"]) & (t["parent"] != b["start"])), lambda t: t["text"]))
    return let(text_or(F.array_join(parts, " ")), lambda t: F.struct(
        TX.emails(t).alias("emails"), TX.phones(t).alias("phones"), TX.opening_hours(t).alias("hours")))


def pricing(p: Page) -> Column:
    """B04 + B05.

    B04: price/plan blocks with text: label, prices_found, text <= 300, kept
    when a price or a price keyword is found.  B05, only for pages without any
    B04 row: elements whose class+id holds a price keyword and whose text holds
    a price; label = class+id <= 50, text <= 200."""
    def row(e: Column, sub: dict[str, Column], blocks: Column) -> Column:
        return let(_text(p, e), lambda t: let(TX.prices(t), lambda found: F.struct(
            e["start"].alias("start"), _text(p, sub["label"]).alias("label"), _class_id(e).alias("class_id"), found.alias("prices_found"), t.alias("text"),
            (F.array_contains(blocks, e["start"]) & (t != "") & ((F.size(found) > 0) | TX.has_keyword(t, TX.PRICE_KEYWORDS))).alias("block"),
            (TX.has_keyword(_class_id(e), TX.PRICE_KEYWORDS) & (F.size(found) > 0)).alias("fallback"))))

    def cut(r: Column, label: str, limits: tuple[str, str]) -> Column:
        return F.struct(r["start"].alias("start"), TX.cut(r[label], LIMITS[limits[0]]).alias("label"), r["prices_found"].alias("prices_found"),
                        TX.cut(r["text"], LIMITS[limits[1]]).alias("text"))

    def rows(blocks: Column) -> Column:
        some = F.filter(p.with_attr("class", "id"), lambda e: F.array_contains(blocks, e["start"]) | TX.has_keyword(_class_id(e), TX.PRICE_KEYWORDS))
        return _blocks(p, some, {"label": PRICE_LABEL_SEL}, lambda e, sub: row(e, sub, blocks))

    every = let(F.transform(p.select(PRICE_SEL), lambda e: e["start"]), rows)
    return let(every, lambda rs: F.when(F.exists(rs, lambda r: r["block"]), F.transform(
        F.filter(rs, lambda r: r["block"]), lambda r: cut(r, "label", ("price_label", "price_text")))).otherwise(F.transform(
            F.filter(rs, lambda r: r["fallback"]), lambda r: cut(r, "class_id", ("fallback_label", "fallback_text")))))


def services(p: Page) -> Column:
    """service/feature/product blocks with text > 20: name, description."""
    found = F.filter(p.select(SERVICE_SEL), lambda e: F.length(_text(p, e)) > LIMITS["service_min"])
    rows = _blocks(p, found, {"name": "h1, h2, h3, h4", "description": "p"}, lambda e, sub: F.struct(
        e["start"].alias("start"), TX.cut(_text(p, sub["name"]), LIMITS["service_name"]).alias("name"),
        TX.cut(_text(p, sub["description"]), LIMITS["service_desc"]).alias("description")))
    return _keep_first(rows, "name")


def team(p: Page) -> Column:
    """Team member blocks: name, role, bio, photo; name or role required."""
    found = F.filter(p.select(TEAM_SEL), lambda e: F.length(_text(p, e)) >= LIMITS["team_min"])
    rows = _blocks(p, found, {"name": TEAM_NAME_SEL, "role": TEAM_ROLE_SEL, "bio": "p", "img": "img"}, lambda e, sub: F.struct(
        e["start"].alias("start"), *[TX.cut(_text(p, sub[n]), LIMITS[f"team_{n}"]).alias(n) for n in ("name", "role", "bio")],
        text_or(sub["img"]["attrs"]["src"]).alias("photo")))
    return _keep_first(F.filter(rows, lambda r: (r["name"] != "") | (r["role"] != "")), "name")


def testimonials(p: Page) -> Column:
    """testimonial/review blocks with text >= 20: text, author."""
    found = F.filter(p.select(TESTIMONIAL_SEL), lambda e: F.length(_text(p, e)) >= LIMITS["testimonial_min"])
    return _blocks(p, found, {"author": AUTHOR_SEL}, lambda e, sub: F.struct(
        e["start"].alias("start"), TX.cut(_text(p, e), LIMITS["testimonial_text"]).alias("text"),
        TX.cut(_text(p, sub["author"]), LIMITS["testimonial_author"]).alias("author")))


def faqs(p: Page) -> Column:
    """FAQ blocks: question (required), answer."""
    rows = _blocks(p, p.select(FAQ_SEL), {"question": QUESTION_SEL, "answer": ANSWER_SEL}, lambda e, sub: F.struct(
        e["start"].alias("start"), TX.cut(_text(p, sub["question"]), LIMITS["faq_q"]).alias("question"),
        TX.cut(_text(p, sub["answer"]), LIMITS["faq_a"]).alias("answer")))
    return F.filter(rows, lambda r: r["question"] != "")


def locations(p: Page) -> Column:
    """Distinct location/address texts longer than 10 characters."""
    texts = F.transform(p.select(LOCATION_SEL), lambda e: _text(p, e))
    return F.array_distinct(F.transform(F.filter(texts, lambda t: F.length(t) > LIMITS["location_min"]), lambda t: TX.cut(t, LIMITS["location_text"])))


def key_stats(p: Page) -> Column:
    """Stat blocks: number (required), label."""
    rows = _blocks(p, p.select(STAT_SEL), {"number": STAT_NUMBER_SEL, "label": STAT_LABEL_SEL}, lambda e, sub: F.struct(
        e["start"].alias("start"), TX.cut(_text(p, sub["number"]), LIMITS["stat_number"]).alias("number"),
        TX.cut(_text(p, sub["label"]), LIMITS["stat_label"]).alias("label")))
    return F.filter(rows, lambda r: r["number"] != "")


rows = RC.rows


def price_value(price: Column) -> Column:
    """B15 (ours): money text -> STRUCT<amount DECIMAL(18,2), currency STRING>."""
    cur = (F.when(price.contains("$"), "USD").when(price.contains("€"), "EUR").when(price.contains("£"), "GBP")
           .when(price.contains("¥"), "JPY").when(price.contains("₹"), "INR")
           .otherwise(F.upper(F.regexp_extract(price, r"(?i)(USD|EUR|MXN|COP)", 1))))
    num = F.regexp_extract(price, r"\d[\d,\.]*", 0)
    num = F.regexp_replace(num, r"[,.]+$", "")
    # a last mark with one or two digits after it is the decimal one ("1.234,50", "1,234.50"), and so is a
    # single point with more than three; all other marks part thousands ("1.234", "1,234.567")
    decimal = num.rlike(r"[,.]\d{1,2}$") | num.rlike(r"^\d*\.\d{4,}$")
    whole = F.regexp_replace(F.when(decimal, F.regexp_extract(num, r"^(.*)[,.]\d+$", 1)).otherwise(num), r"[,.]", "")
    clean = F.when(decimal, F.concat(whole, F.lit("."), F.regexp_extract(num, r"[,.](\d+)$", 1))).otherwise(whole)
    return F.struct(clean.try_cast("decimal(18,2)").alias("amount"), cur.alias("currency"))


def extract_business(dom: D.Dom) -> DataFrame:
    """One nested record per page; parts without any item are empty lists."""
    def plain(part: Callable[[Page], Column], *fields: str) -> Callable[[Page], Column]:
        return lambda p: F.transform(part(p), lambda r: F.struct(*[r[f].alias(f) for f in fields]))

    return RC.parts(dom, contact=contact, pricing=plain(pricing, "label", "prices_found", "text"),
                    services=plain(services, "name", "description"), team=plain(team, "name", "role", "bio", "photo"),
                    testimonials=plain(testimonials, "text", "author"), faqs=plain(faqs, "question", "answer"),
                    locations=lambda p: F.array_sort(locations(p)), stats=plain(key_stats, "number", "label"))
