"""Organisation and person records.

Remote search, login and paid APIs are not built (SURVEY section 8); what is
built is the data work on records already captured: card extraction from
result pages, canonical URLs, de-duplication, enrichment joins, payload
normalisation (VARIANT -> typed columns) and seniority scoring.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webrel.functions import text as TX
from webrel.functions import urls as U
from webrel.operators import dom as D
from webrel.operators import page as P
from webrel.operators import record as RC
from webrel.operators.tree import Page, encode, let, on_page

# --- fixed values -----------------------------------------------------------
# Result-card selectors, tried in this order; the first with output wins.
CARD_SELECTORS = [
    "li.reusable-search__result-container",
    "li[class*='result-container']",
    ".entity-result",
    "[data-view-name='search-entity-result-universal-template']",
    "div[data-chameleon-result-urn]",
]
PRIMARY_SUB_SEL = ".entity-result__primary-subtitle, [class*='primary-subtitle']"
SECONDARY_SUB_SEL = ".entity-result__secondary-subtitle, [class*='secondary-subtitle']"
# Button labels that are never names or subtitles.
UI_LABELS = ["Seguir", "Follow", "Conectar", "Connect", "Pending", "Pendiente", "·", "•",
             "Ver más", "See more", "Reactivar", "Premium", "Mensaje", "Message"]
# Canonical company URL pattern (case-insensitive).
COMPANY_URL_RE = r"(?i)(https?://(?:www\.)?linkedin\.com/company/[A-Za-z0-9_%-]+)"
# dl detail keys and their Spanish aliases.
DETAIL_ALIASES = {"headquarters": ["headquarters", "sede"], "founded": ["founded", "fundada"],
                  "industry": ["industry", "sector"]}
# Seniority keywords in the reference's dict order with their scores.
SENIORITY_SCORE = [("ceo", 10), ("cto", 10), ("coo", 9), ("cpo", 9), ("cmo", 8), ("cio", 8),
                   ("founder", 10), ("co-founder", 10), ("cofounder", 10),
                   ("president", 9), ("vp", 8), ("vice president", 8),
                   ("director", 7), ("head", 7), ("lead", 6), ("senior", 5), ("principal", 6)]
# Search filter code tables.
SENIORITY_CODES = {"c_suite": "10", "vp": "9", "director": "8", "manager": "7", "senior": "6", "entry": "3"}
INDUSTRY_CODES = {"hospital_healthcare": "14", "health_wellness_fitness": "96", "biotechnology": "42",
                  "pharmaceuticals": "82", "medical_devices": "74", "mental_health": "139",
                  "medical_practice": "54", "research": "87"}
GEO_URNS = {"usa": "urn:li:geo:103644278", "latam": "urn:li:geo:91000001",
            "mexico": "urn:li:geo:103323778", "colombia": "urn:li:geo:100876405",
            "brazil": "urn:li:geo:106057199", "uk": "urn:li:geo:101165590",
            "spain": "urn:li:geo:105646813"}
# ---------------------------------------------------------------------------


def base_company_url(href: Column) -> Column:
    """``.../company/<slug>/anything?q`` -> ``.../company/<slug>`` ('' if none)."""
    return F.regexp_extract(href, COMPANY_URL_RE, 1)


def _inner_text(parts: Column) -> Column:
    return TX.pystrip(F.array_join(parts, ""))


_CARD_PARTS = {"link": "a[href*='/company/']", "aria": "span[aria-hidden]", "h": "h3, h4", "p1": PRIMARY_SUB_SEL, "p2": SECONDARY_SUB_SEL}


def _cards(p: Page) -> Column:
    """Result cards with a company link and a name, of the first selector that yields any."""
    def card(e: Column, subs: dict[str, Column]) -> Column:
        def of(link: Column) -> Column:
            text = {n: RC.inner_text(p, RC.first_within(e, subs[n])) for n in ("h", "p1", "p2")}
            label = F.coalesce(RC.inner_text(p, RC.first_within(link, subs["aria"])), RC.inner_text(p, link))
            return F.struct(
                e["start"].alias("start"), F.coalesce(F.nullif(label, F.lit("")), text["h"], F.lit("")).alias("name"),
                base_company_url(link["attrs"]["href"]).alias("url"), RC.text_or(text["p1"]).alias("industry_size"),
                RC.text_or(text["p2"]).alias("location"), F.lit("card").alias("source"))

        return let(RC.first_within(e, subs["link"]), lambda link: F.when(link.isNotNull(), of(link)))

    def bind(names: list[str], subs: dict[str, Column], found: Column) -> Column:
        if names:
            return let(p.select(_CARD_PARTS[names[0]]), lambda m: bind(names[1:], {**subs, names[0]: m}, found))
        # a card is no link of a card
        starts = F.transform(found, lambda e: e["start"])
        links = let(starts, lambda st: F.filter(subs["link"], lambda x: ~F.array_contains(st, x["start"])))
        rows = let(links, lambda ls: F.filter(F.transform(found, lambda e: card(e, {**subs, "link": ls})), lambda c: c.isNotNull() & (
            c["url"] != "") & (F.length(c["name"]) >= 2)))
        return let(rows, lambda rs: RC.first_rows([lambda s=s: matched(s, rs) for s in CARD_SELECTORS]))

    def matched(selector: str, rows: Column) -> Column:
        return let(F.transform(p.select(selector), lambda e: e["start"]), lambda st: F.filter(rows, lambda c: F.array_contains(st, c["start"])))

    return let(p.select(", ".join(CARD_SELECTORS)), lambda found: bind(list(_CARD_PARTS), {}, found))


def org_cards(dom: D.Dom) -> DataFrame:
    """Result cards; per page only the first selector that yields a card."""
    return RC.rows(dom, _cards)


def org_details(dom: D.Dom) -> DataFrame:
    """``dl`` details (each dt -> the next dt/dd element's text) with
    the Spanish aliases."""
    e = dom.el.filter(F.col("tag").isin("dt", "dd"))
    e = P.deep_parts(dom, e.select("page_id", "start", "tag", "start_tc", "end_tc"))
    e = e.withColumn("t", _inner_text(F.col("parts")))
    w = Window.partitionBy("page_id").orderBy("start")
    e = e.withColumn("nxt", F.lead("t").over(w)).filter(F.col("tag") == "dt")
    # a repeated dt: the last one counts
    e = e.groupBy("page_id", F.lower("t").alias("k")).agg(F.max_by(F.coalesce("nxt", F.lit("")), "start").alias("v"))
    kv = e.groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("d"))
    out = [F.coalesce(*[F.nullif(F.col("d")[k], F.lit("")) for k in keys], F.lit("")).alias(name)
           for name, keys in DETAIL_ALIASES.items()]
    return kv.select("page_id", *out)


def followers_and_size(text: Column) -> tuple[Column, Column]:
    """Follower count and employee range from page text."""
    f = F.regexp_extract(text, r"(?i)([\d,]+)\s*follower", 1)
    emp = F.regexp_extract(text, r"(?i)(\d[\d,]*\s*[-–]\s*\d[\d,]*|\d[\d,]+\+?)\s*employees?", 0)
    return F.replace(f, F.lit(","), F.lit("")).try_cast("bigint"), TX.pystrip(emp)


def total_results(text: Column) -> Column:
    """First number, separators removed, 0 when none."""
    n = F.regexp_extract(text, r"([\d,\.]+)", 1)
    n = F.regexp_replace(n, r"[,\.]", "")
    return F.coalesce(n.try_cast("bigint"), F.lit(0).cast("bigint"))


def ui_label_filter(texts: Column) -> Column:
    """Distinct texts in order, without known button labels."""
    return F.array_except(F.array_distinct(texts), F.array(*[F.lit(x) for x in UI_LABELS]))


def dedupe_entities(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Keep the first row per key, key = first non-empty of ``keys``
    (names are compared lower-cased and trimmed); rows without key dropped.
    One aggregation, so a hot key is combined map-side."""
    k = F.coalesce(*[F.nullif(F.lower(TX.pystrip(F.col(c))) if c == "name" else F.col(c), F.lit(""))
                     for c in keys])
    cols = df.columns
    return (df.withColumn("_k", k).filter(F.col("_k").isNotNull()).groupBy("_k")
            .agg(F.min_by(F.struct(*cols), F.col(order)).alias("_r")).select("_r.*"))


def top_n(df: DataFrame, order: str, n: int) -> DataFrame:
    """First ``n`` rows in ``order`` (TakeOrderedAndProject)."""
    return df.orderBy(order).limit(n)


def drop_empty(df: DataFrame, cols: list[str]) -> DataFrame:
    """Empty strings become NULL (0 is kept)."""
    return df.select(*[F.nullif(F.col(c), F.lit("")).alias(c) if c in cols else F.col(c) for c in df.columns])


def enrich(stubs: DataFrame, profiles: DataFrame, key: str, overwrite: str = "non_empty") -> DataFrame:
    """Stub LEFT JOIN profile on ``key``; profile fields win.  With
    ``overwrite='non_empty'`` (default, decision Q8) an empty profile value
    keeps the stub's value; ``'all'`` lets it overwrite as the API path does."""
    p = profiles.select(key, *[F.col(c).alias(f"_p_{c}") for c in profiles.columns if c != key])
    j = stubs.join(p, key, "left")
    out = []
    for c in stubs.columns:
        if c == key or f"_p_{c}" not in j.columns:
            out.append(F.col(c))
            continue
        pv = F.col(f"_p_{c}")
        if overwrite == "all":
            out.append(F.when(pv.isNotNull(), pv).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.coalesce(F.nullif(pv.cast("string"), F.lit("")).cast(stubs.schema[c].dataType),
                                  F.col(c)).alias(c))
    extra = [F.col(f"_p_{c}").alias(c) for c in profiles.columns if c != key and c not in stubs.columns]
    return j.select(*out, *extra)


def code_lookup(keys: Column, table: dict[str, str]) -> Column:
    """Key -> code through a literal map; unknown keys pass through."""
    m = F.create_map(*[x for kv in table.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return F.coalesce(m[keys], keys)


def seniority_score(headline: Column, title: Column, mode: str = "word") -> Column:
    """First keyword (fixed order) found in headline (else title) -> score, else 1.

    ``substring`` reproduces the reference exactly ("director" contains "cto"
    and scores 10); ``word`` (default, decision Q1) matches whole words and
    tests "vice president" before "president"."""
    h = F.lower(F.coalesce(F.nullif(headline, F.lit("")), title, F.lit("")))
    order = list(SENIORITY_SCORE)
    if mode == "word":
        order.remove(("vice president", 8))
        order.insert(order.index(("president", 9)), ("vice president", 8))
    expr = F.lit(1)
    for kw, sc in reversed(order):
        if mode == "word":
            hit = h.rlike(r"(?<![\p{L}\p{N}_-])" + kw.replace(" ", r"\s+") + r"(?![\p{L}\p{N}_-])")
        else:
            hit = h.contains(kw)
        expr = F.when(hit, F.lit(sc)).otherwise(expr)
    return expr


def rank_by_score(df: DataFrame, score: str, pos: str) -> DataFrame:
    """Stable descending sort by score (input order among equals) and
    ``outreach_priority`` = score."""
    return df.withColumn("outreach_priority", F.col(score)).orderBy(F.col(score).desc(), F.col(pos).asc())


def paged_results(df: DataFrame, page_col: str, pos_col: str, count: int | None = None) -> DataFrame:
    """Concatenate result pages in order, stop at the first empty page
    (pages after a gap in ``page_no`` are dropped), then keep ``count`` rows."""
    pages = df.select(F.col(page_col).cast("long").alias("p")).distinct()
    # the first missing number: 1, or the smallest successor of a page that is no page
    after = pages.select((F.col("p") + 1).alias("p")).union(df.sparkSession.range(1, 2).toDF("p"))
    first_gap = after.join(pages, "p", "left_anti").agg(F.min("p").alias("_gap"))
    kept = df.withColumn("_one", F.lit(1)).join(F.broadcast(first_gap.withColumn("_one", F.lit(1))), "_one")   # one row
    kept = kept.drop("_one").filter(F.col("_gap").isNull() | (F.col(page_col) < F.col("_gap")))
    kept = kept.drop("_gap").orderBy(page_col, pos_col)
    return kept.limit(count) if count else kept


# --- payload normalisation (E17-E27) -------------------------------------------------
def _vs(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "string"), F.lit(""))


def _texts(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "array<string>"), F.array().cast("array<string>"))


def _variants(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def normalize_org(payload: Column, url: Column, source: str = "company_payload") -> Column:
    """Nested company payload (VARIANT) -> organisation STRUCT."""
    hq_city = F.try_variant_get(payload, "$.hq.city", "string")
    hq_country = F.try_variant_get(payload, "$.hq.country", "string")
    industries = _texts(payload, "$.industries")
    return F.struct(
        _vs(payload, "$.name").alias("name"), url.alias("profile_url"),
        _vs(payload, "$.website").alias("website"), _vs(payload, "$.description").alias("description"),
        F.when(F.size(industries) > 0, F.try_element_at(industries, F.lit(1)))
        .otherwise(_vs(payload, "$.industry")).alias("industry"),
        industries.alias("industries"), _texts(payload, "$.specialities").alias("specialties"),
        _vs(payload, "$.company_size_on_linkedin").alias("employee_count"),
        F.concat_ws(", ", F.nullif(hq_city, F.lit("")), F.nullif(hq_country, F.lit(""))).alias("headquarters"),
        _vs(payload, "$.founded_year").alias("founded"), _vs(payload, "$.type").alias("company_type"),
        _vs(payload, "$.follower_count").alias("follower_count"), _vs(payload, "$.linkedin_id").alias("linkedin_id"),
        _vs(payload, "$.tagline").alias("tagline"),
        key_employees(payload).alias("key_employees"),
        funding(payload).alias("funding"), F.lit(source).alias("source"),
    )


_EXP = ("array<struct<title:string,company:string,location:string,description:string,"
        "starts_at:struct<year:int,month:int>,ends_at:struct<year:int,month:int>>>")
_EDU = "array<struct<school:string,degree_name:string,field_of_study:string,ends_at:struct<year:int>>>"


def key_employees(payload: Column) -> Column:
    """The objects among the first 10 employees, name = first + ' ' + last (not trimmed)."""
    objects = F.filter(F.slice(_variants(payload, "$.employees"), 1, 10),
                       lambda e: F.try_variant_get(e, "$", "map<string,variant>").isNotNull())
    return F.transform(objects, lambda e: F.struct(
        F.concat(_vs(e, "$.first_name"), F.lit(" "), _vs(e, "$.last_name")).alias("name"),
        _vs(e, "$.title").alias("title"), _vs(e, "$.profile_url").alias("profile_url")))


def funding(payload: Column) -> Column:
    """Funding rounds (type, amount, year, lead investors); NULL when absent.  ``amount`` is the
    number, where it is one, ``amount_text`` what the payload says."""
    rounds = _variants(payload, "$.funding_data")
    conv = F.transform(rounds, lambda r: F.struct(
        _vs(r, "$.funding_type").alias("type"), F.try_variant_get(r, "$.money_raised", "bigint").alias("amount"),
        F.try_variant_get(r, "$.announced_date.year", "int").alias("year"),
        F.transform(_variants(r, "$.lead_investors"), lambda i: _vs(i, "$.name")).alias("investors"),
        _vs(r, "$.money_raised").alias("amount_text")))
    return F.when(F.size(rounds) > 0, F.struct(
        F.try_variant_get(payload, "$.total_funding_amount", "bigint").alias("total_raised"), conv.alias("rounds")))


def _ym(s: Column) -> Column:
    """``f"{year}-{month}".strip("-")`` without zero padding."""
    y = F.coalesce(s["year"].cast("string"), F.lit(""))
    m = F.coalesce(s["month"].cast("string"), F.lit(""))
    return F.regexp_replace(F.concat(y, F.lit("-"), m), r"^-+|-+$", "")


def _experiences(payload: Column) -> Column:
    return F.coalesce(F.try_variant_get(payload, "$.experiences", _EXP), F.array().cast(_EXP))


def experience(payload: Column) -> Column:
    """Experience rows; 'Present' when no end; description <= 300."""
    return F.transform(_experiences(payload), lambda x: F.struct(
        F.coalesce(x["title"], F.lit("")).alias("title"), F.coalesce(x["company"], F.lit("")).alias("company"),
        F.coalesce(x["location"], F.lit("")).alias("location"), _ym(x["starts_at"]).alias("start"),
        F.when(x["ends_at"].isNull(), F.lit("Present")).otherwise(_ym(x["ends_at"])).alias("end"),
        TX.cut(F.coalesce(x["description"], F.lit("")), 300).alias("description")))


def education(payload: Column) -> Column:
    """Education rows."""
    eds = F.coalesce(F.try_variant_get(payload, "$.education", _EDU), F.array().cast(_EDU))
    return F.transform(eds, lambda x: F.struct(
        F.coalesce(x["school"], F.lit("")).alias("school"), F.coalesce(x["degree_name"], F.lit("")).alias("degree"),
        F.coalesce(x["field_of_study"], F.lit("")).alias("field"), x["ends_at"]["year"].alias("end_year")))


def skills(payload: Column) -> Column:
    """skill = ``name`` of an object, else the value as text."""
    arr = F.coalesce(F.try_variant_get(payload, "$.skills", "array<variant>"), F.array().cast("array<variant>"))
    return F.transform(arr, lambda s: F.coalesce(F.try_variant_get(s, "$.name", "string"),
                                                 F.try_variant_get(s, "$", "string"), F.lit("")))


def normalize_person(payload: Column, url: Column) -> Column:
    """Nested person payload -> person STRUCT; current = first experience."""
    current = F.get(_experiences(payload), F.lit(0))
    first, last = _vs(payload, "$.first_name"), _vs(payload, "$.last_name")
    emails = F.try_variant_get(payload, "$.personal_emails", "array<string>")
    phones = F.try_variant_get(payload, "$.personal_numbers", "array<string>")
    return F.struct(
        TX.pystrip(F.concat(first, F.lit(" "), last)).alias("name"), first.alias("first_name"),
        last.alias("last_name"), url.alias("profile_url"), _vs(payload, "$.headline").alias("headline"),
        _vs(payload, "$.summary").alias("summary"),
        F.coalesce(F.nullif(_vs(payload, "$.city"), F.lit("")), _vs(payload, "$.country_full_name")).alias("location"),
        _vs(payload, "$.country_full_name").alias("country"),
        F.coalesce(current["title"], F.lit("")).alias("current_title"),
        F.coalesce(current["company"], F.lit("")).alias("current_company"),
        F.when(F.size(emails) > 0, F.try_element_at(emails, F.lit(1))).otherwise(F.lit("")).alias("email"),
        F.when(F.size(phones) > 0, F.try_element_at(phones, F.lit(1))).otherwise(F.lit("")).alias("phone"),
        skills(payload).alias("skills"), experience(payload).alias("experience"), education(payload).alias("education"),
    )


def employees_of(people: DataFrame, org_value, role: str | None = None, org_col: str = "c_nationkey",
                 title_col: str = "c_mktsegment", name_col: str = "c_name", id_col: str = "c_custkey",
                 count: int | None = None) -> DataFrame:
    """People of one organisation, optionally with a role keyword
    (lower-cased substring of the title), the first ``count`` of them by id."""
    p = people.filter(F.col(org_col) == org_value)
    if role:
        p = p.filter(F.lower(F.col(title_col)).contains(role.lower()))
    p = p.orderBy(id_col).limit(count) if count else p
    return p.select(F.col(id_col).alias(id_col), F.col(name_col).alias("name"), F.col(title_col).alias("title"))


# Link scan (E02 / E04 strategy 2) ----------------------------------------------------
_INLINE = {"company": ["span", "a", "b", "em", "strong", "i"], "in": ["span", "a", "b", "em"]}
_SKIP_UI = {"company": UI_LABELS, "in": ["Conectar", "Connect", "Seguir", "Follow", "Mensaje", "Message",
                                          "Pending", "·", "•"]}
_LIMITS = {"company": (120, 100), "in": (80, 120)}  # max name length, max leaf length (exclusive)


def _scan_links(p: Page, kind: str) -> Column:
    """``start, url, name, container`` of the first link to each URL in the main content."""
    def url_of(e: Column) -> Column:
        href = e["attrs"]["href"]
        return base_company_url(href) if kind == "company" else F.regexp_replace(F.split(href, r"\?")[0], "/$", "")

    def wanted(url: Column) -> Column:
        if kind == "company":
            return url != ""
        tail = F.regexp_replace(url, r".*/in/[^/]+", "")
        return ~url.endswith("/messaging") & ~url.contains("/in/undefined") & (F.length(tail) <= 1) & (url != "")

    def links(outside: Column, root: Column) -> Column:
        found = F.filter(p.select(f"a[href*='/{kind}/']"), lambda e: ~F.array_contains(outside, e["start"]) & RC.in_element(root, e["start"]))
        found = F.filter(F.transform(found, lambda e: F.struct(*[e[n].alias(n) for n in ("start", "end", "void", "parent_start")], url_of(e).alias("url"))),
                         lambda e: wanted(e["url"]))
        return let(found, lambda ls: let(F.transform(ls, lambda e: e["url"]), lambda us: F.filter(
            ls, lambda e, i: F.array_position(us, e["url"]) == i + 1)))

    def named(found: Column, aria: Column, lis: Column, divs: Column) -> Column:
        """With name and container: the closest li, else the closest div[class], else the parent."""
        rows = F.transform(found, lambda e: F.struct(
            e["start"].alias("start"), e["url"].alias("url"),
            RC.text_or(F.coalesce(RC.inner_text(p, RC.first_within(e, aria)), RC.inner_text(p, e))).alias("name"),
            F.coalesce(RC.closest(e["start"], lis)["start"], RC.closest(e["start"], divs)["start"], e["parent_start"]).alias("container")))
        return F.filter(rows, lambda r: F.length(r["name"]).between(2, _LIMITS[kind][0]))

    excl = "nav a, header a, footer a" + (", aside a" if kind == "in" else "")
    root = F.coalesce(*[RC.first(p.select(s)) for s in (".scaffold-layout__main", "main", "body")])
    found = let(F.transform(p.select(excl), lambda e: e["start"]), lambda out: let(root, lambda r: links(out, r)))
    divs = F.filter(p.els, lambda e: (e["tag"] == "div") & e["attrs"]["class"].isNotNull())
    return let(p.select("span[aria-hidden]"), lambda aria: let(RC.tagged(p, "li"), lambda lis: let(divs, lambda ds: named(found, aria, lis, ds))))


def _scan_leaves(p: Page, kind: str, links: Column) -> Column:
    """``container, t``: texts of the leaves of the containers of ``links``."""
    skip = F.array(*[F.lit(x) for x in _SKIP_UI[kind]])

    def leaves(used: Column, holders: Column) -> Column:
        some = F.transform(F.filter(p.els, lambda x: x["tag"].isin("span", "div", "p")), lambda x: F.struct(
            *[x[n].alias(n) for n in ("start", "end")], RC.closest(x["start"], used)["start"].alias("container")))
        some = F.filter(some, lambda x: x["container"].isNotNull() & ~F.array_contains(holders, x["start"]))
        return F.filter(F.transform(some, lambda x: F.struct(x["container"].alias("container"), RC.inner_text(p, x).alias("t"))), lambda x: (
            F.length(x["t"]) > 2) & (F.length(x["t"]) < _LIMITS[kind][1]) & ~F.array_contains(skip, x["t"]) & ~x["t"].contains("\n"))

    containers = F.array_distinct(F.array_compact(F.transform(links, lambda e: e["container"])))
    used = let(containers, lambda cs: F.filter(p.els, lambda x: F.array_contains(cs, x["start"])))
    holders = F.array_distinct(F.array_compact(F.transform(F.filter(p.els, lambda x: ~x["tag"].isin(_INLINE[kind])), lambda x: x["parent_start"])))
    return let(used, lambda us: let(holders, lambda hs: leaves(us, hs)))


def _scan_rows(links: Column, leaves: Column, kind: str) -> Column:
    a, b = ("industry_size", "location") if kind == "company" else ("headline", "location")

    def row(e: Column, own: Column) -> Column:
        return F.struct(e["start"].alias("start"), e["name"].alias("name"), e["url"].alias("url"), RC.text_or(F.get(own, F.lit(0))).alias(a),
                        RC.text_or(F.get(own, F.lit(1))).alias(b), F.lit("link_scan" if kind == "company" else "dom_link").alias("source"))

    return F.transform(links, lambda e: let(F.array_distinct(F.transform(F.filter(
        leaves, lambda x: (x["container"] == e["container"]) & (x["t"] != e["name"])), lambda x: x["t"])), lambda own: row(e, own)))


def searched(dom: D.Dom, kind: str, cards: Callable[[Page], Column] | None = None) -> DataFrame:
    """The rows of ``link_scan``; with ``cards``, of the cards of each page that has any, and of the link scan on the others.
    Each step is a column, read from the one parse of the page."""
    page = encode(dom).withColumn("cards", on_page(cards) if cards else F.lit(None))
    none = F.coalesce(F.size("cards") == 0, F.lit(True)) if cards else F.lit(True)
    page = page.withColumn("links", F.when(none, on_page(lambda p: _scan_links(p, kind))))
    page = page.withColumn("leaves", F.when(none, on_page(lambda p: _scan_leaves(p, kind, F.col("links")))))
    scan = _scan_rows(F.col("links"), F.col("leaves"), kind)
    rows = page.select("page_id", (F.when(none, scan).otherwise(F.col("cards")) if cards else scan).alias("x"))
    return D.exploded(rows, "x", "x").select("page_id", "x.*")


def link_scan(dom: D.Dom, kind: str = "company") -> DataFrame:
    """E02 / E04 fallback: ``/company/`` (or ``/in/``) links in the main
    content, outside nav/header/footer (and aside for people): canonical URL,
    name (aria text, else link text), and the first two distinct leaf texts of
    the link's container (closest li, else closest div[class], else parent).
    Leaves are the container's nearest descendants span/div/p whose element
    children are inline only."""
    return searched(dom, kind)


def org_search(dom: D.Dom) -> DataFrame:
    """E01 then E02 for pages without any card (one ``card``/``link_scan`` source per page)."""
    return searched(dom, "company", _cards)
