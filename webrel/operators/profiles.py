"""Organisation and person profile pages, card lists, filters and reports
(E04, E11, E13, E24, E25-E27, E29, E33, E34).

A profile field is a chain of selectors; the first that gives text wins.  All
selectors of a page kind are flags of one elements pass: one aggregate per page
finds the first element of each selector, one join fetches their texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webrel.functions import text as TX
from webrel.functions import urls as U
from webrel.operators import dom as D
from webrel.operators import entities as EN
from webrel.operators import page as P
from webrel.operators import record as RC
from webrel.operators import tree as T
from webrel.operators.select import flag

# --- fixed values -----------------------------------------------------------
# Selector chains of an organisation page.
ORG_CHAINS = {
    "name": ["h1", ".org-top-card-summary__title"],
    "description": [".org-about-us-organization-description__text", "[data-test-id='about-us__description']",
                    ".org-about-module__description", "section.about-us p"],
    "specialties": [".org-about-us-organization-description__text--specialties"],
}
ORG_WEBSITE = ["a[data-control-name='visit_company_website']", ".org-about-us-organization-description a[href*='http']"]
# Selector chains of a person page.
PERSON_CHAINS = {
    "name": ["h1", ".pv-text-details__left-panel h1"],
    "headline": [".pv-text-details__left-panel .text-body-medium", "[data-generated-suggestion-target]",
                 ".top-card-layout__headline"],
    "location": [".pv-text-details__left-panel .text-body-small[class*='break-words']", ".top-card__subline-item"],
    "summary": ["#about ~ div .visually-hidden", ".pv-shared-text-with-see-more .visually-hidden", ".summary"],
}
PERSON_ITEMS = "[id='experience'] ~ div li, .pvs-list__item--line-separated"
PERSON_CARD_SELECTORS = [
    "li.reusable-search__result-container", "li[class*='result-container']", ".entity-result",
    "[data-view-name='search-entity-result-universal-template']", ".search-results-container > ul > li",
]
CONNECTIONS_RE = r"(?i)([\d,]+)\s*connections?"
EXPERIENCES = 10
# Titles of a recruiting search without titles of its own.
RECRUITING_TITLES = ["CTO", "Founder", "CEO", "VP Engineering", "CPO"]
TITLES_USED = 3
REPORT_ROWS = 20
# ---------------------------------------------------------------------------


def first_texts(dom: D.Dom, chains: dict[str, list[str]]) -> DataFrame:
    """Per page the first non-empty text of each chain ('' if none)."""
    e, names = dom.elements, []
    for field, selectors in chains.items():
        for k, s in enumerate(selectors):
            names.append((field, f"_s_{field}_{k}"))
            e = flag(e, s, names[-1][1])
    e = e.withColumn("_any", reduce(lambda a, b: a | b, [F.col(n) for _, n in names]))
    firsts = e.filter("_any").groupBy("page_id").agg(*[
        F.min(F.when(F.col(n), F.col("start"))).alias(n) for _, n in names])
    wanted = firsts.select("page_id", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.col(n).alias("at"))
                                                         for _, n in names])).alias("w")).select("page_id", "w.n", F.col("w.at").alias("start"))
    ends = e.select("page_id", "start", "start_tc", "end_tc")
    text = P.deep_parts(dom, wanted.filter("start is not null").join(ends, ["page_id", "start"]))
    text = text.withColumn("t", TX.pystrip(F.array_join("parts", "")))
    cols = [F.coalesce(*[F.nullif(F.max(F.when(F.col("n") == n, F.col("t"))), F.lit("")) for f, n in names if f == field],
                       F.lit("")).alias(field) for field in chains]
    return text.groupBy("page_id").agg(*cols)


def org_profile(dom: D.Dom, pages: DataFrame) -> DataFrame:
    """One row per page: name, description, website, followers, employee_count,
    specialties and the ``dl`` details (headquarters, founded, industry)."""
    base = pages.select("page_id")
    e = dom.elements
    for k, s in enumerate(ORG_WEBSITE):
        e = flag(e, s, f"_w{k}")
    site = e.filter(F.col("_w0") | F.col("_w1")).groupBy("page_id").agg(F.coalesce(*[
        F.min_by(F.when(F.col(f"_w{k}"), F.coalesce(F.col("attrs")["href"], F.lit(""))), F.when(F.col(f"_w{k}"), F.col("start")))
        for k in range(len(ORG_WEBSITE))]).alias("website"))
    body = P.full_text(dom).select("page_id", F.col("full_text").alias("body"))
    followers, size = EN.followers_and_size(F.col("body"))
    out = (base.join(first_texts(dom, ORG_CHAINS), "page_id", "left").join(site, "page_id", "left")
           .join(body, "page_id", "left").join(EN.org_details(dom), "page_id", "left"))
    text = ["name", "description", "website", "headquarters", "founded", "industry"]
    parts = F.filter(F.transform(F.split(F.coalesce("specialties", F.lit("")), ","), TX.pystrip), lambda s: s != "")
    return out.select("page_id", *[F.coalesce(c, F.lit("")).alias(c) for c in text], followers.alias("followers"),
                      F.coalesce(size, F.lit("")).alias("employee_count"), parts.alias("specialties"))


def person_profile(dom: D.Dom) -> DataFrame:
    """One row per page: name, headline, location, summary, connections, current
    title and company (of the first experience item), and the items with a title
    among the first ten.  An element's first ``span[aria-hidden]`` inside stands for it."""
    def nth(s: Column, k: int) -> Column:
        return RC.text_or(F.get(s, F.lit(k - 1)))

    def chain(p: T.Page, selectors: list[str], aria: Column) -> Column:
        shown = lambda s: T.let(RC.first(p.select(s)), lambda e: RC.inner_text(p, F.coalesce(RC.first_within(e, aria), e)))
        return F.coalesce(*[F.nullif(shown(s), F.lit("")) for s in selectors], F.lit(""))

    def experience(p: T.Page, items: Column) -> Column:
        """Per item the texts of the spans whose closest item it is."""
        def of(owned: Column) -> Column:
            return F.transform(items, lambda i: F.transform(F.filter(owned, lambda x: x["item"] == i["start"]), lambda x: x["t"]))

        spans = F.transform(p.select("span[aria-hidden='true']"), lambda e: F.struct(
            RC.closest(e["start"], items)["start"].alias("item"), RC.inner_text(p, e).alias("t")))
        return T.let(F.filter(spans, lambda x: x["t"] != ""), of)

    def fields(p: T.Page) -> Column:
        def of(aria: Column, items: Column) -> Column:
            ten = F.filter(F.slice(items, 1, EXPERIENCES), lambda s: nth(s, 1) != "")
            return F.struct(
                *[chain(p, selectors, aria).alias(k) for k, selectors in PERSON_CHAINS.items()],
                F.replace(F.regexp_extract(RC.full_text(p), CONNECTIONS_RE, 1), F.lit(","), F.lit("")).alias("connections"),
                nth(RC.first(items), 1).alias("current_title"), nth(RC.first(items), 2).alias("current_company"),
                F.transform(ten, lambda s: F.struct(nth(s, 1).alias("title"), nth(s, 2).alias("company"), nth(s, 3).alias("date_range"))).alias("experience"))

        return T.let(p.select("span[aria-hidden]"), lambda aria: T.let(p.select(PERSON_ITEMS), lambda found: T.let(
            experience(p, found), lambda items: of(aria, items))))

    return RC.parts(dom, f=fields).select("page_id", "f.*")


def _cards(p: T.Page) -> Column:
    """Result cards with a link and a name, of the first selector that any element matches."""
    def card(e: Column, subs: dict[str, Column]) -> Column:
        def of(link: Column) -> Column:
            text = {n: RC.inner_text(p, RC.first_within(e, subs[n])) for n in ("h", "p1", "p2")}
            label = RC.inner_text(p, F.coalesce(RC.first_within(link, subs["aria"]), link))
            return F.struct(
                e["start"].alias("start"), F.coalesce(F.nullif(label, F.lit("")), text["h"], F.lit("")).alias("name"),
                U.clean_url(link["attrs"]["href"]).alias("url"), RC.text_or(text["p1"]).alias("headline"),
                RC.text_or(text["p2"]).alias("location"), F.lit("dom_card").alias("source"))

        return T.let(RC.first_within(e, subs["link"]), lambda link: F.when(link.isNotNull(), of(link)))

    def bind(names: list[str], subs: dict[str, Column]) -> Column:
        if names:
            return T.let(p.select(_CARD_PARTS[names[0]]), lambda m: bind(names[1:], {**subs, names[0]: m}))
        found = RC.first_rows([lambda s=s: p.select(s) for s in PERSON_CARD_SELECTORS])
        return F.filter(F.transform(found, lambda e: card(e, subs)), lambda c: c.isNotNull() & (F.length(c["name"]) >= 2))

    return bind(list(_CARD_PARTS), {})


_CARD_PARTS = {"link": "a[href*='/in/']", "aria": "span[aria-hidden]", "h": "h3, h4", "p1": EN.PRIMARY_SUB_SEL, "p2": EN.SECONDARY_SUB_SEL}


def person_cards(dom: D.Dom) -> DataFrame:
    """People result cards; per page only the first selector that has cards."""
    return RC.rows(dom, _cards)


def person_search(dom: D.Dom) -> DataFrame:
    """E04 with its fallback: cards, or links on pages without a card."""
    return EN.searched(dom, "in", _cards)


def entity_filter(df: DataFrame, keywords: str | None = None, titles: list[str] | None = None, industries: list[str] | None = None,
                  seniority: list[str] | None = None, location: str | None = None, min_employees: int | None = None,
                  max_employees: int | None = None, text_cols: tuple = ("name", "headline"), title_col: str = "headline",
                  industry_col: str = "industry", seniority_col: str = "seniority", location_col: str = "location",
                  employees_col: str = "employees", industry_codes: dict | None = None, seniority_codes: dict | None = None,
                  geo_codes: dict | None = None) -> DataFrame:
    """E29 over tables already held: every word of ``keywords`` occurs in a text
    column; one of the first three ``titles`` in the title; industry, seniority and
    location equal one of those asked for, by name or by the code of the name; the
    number of employees lies in the range.  What is not asked for does not filter."""
    cond = []
    has = lambda c, s: F.lower(F.coalesce(F.col(c), F.lit(""))).contains(s.lower())
    for word in (keywords or "").split():
        cond.append(reduce(lambda a, b: a | b, [has(c, word) for c in text_cols]))
    if titles:
        cond.append(reduce(lambda a, b: a | b, [has(title_col, t) for t in titles[:TITLES_USED]]))
    for asked, col, codes in ((industries, industry_col, industry_codes), (seniority, seniority_col, seniority_codes),
                              ([location] if location else None, location_col, geo_codes)):
        if asked:
            names = [a.lower() for a in asked]
            cond.append(F.lower(F.col(col)).isin(*names, *[str((codes or {}).get(a, a)).lower() for a in names]))
    if min_employees is not None:
        cond.append(F.col(employees_col) >= min_employees)
    if max_employees is not None:
        cond.append(F.col(employees_col) <= max_employees)
    return df.filter(reduce(lambda a, b: a & b, cond)) if cond else df


def search_rows(payload: Column, kind: str) -> Column:
    """Summary of a search result (VARIANT): ``org`` or ``person``."""
    v = lambda path: F.coalesce(F.try_variant_get(payload, path, "string"), F.lit(""))
    if kind == "org":
        return F.struct(v("$.name").alias("name"), v("$.linkedin_profile_url").alias("url"), v("$.website").alias("website"),
                        v("$.industry").alias("industry"), v("$.company_size_on_linkedin").alias("employee_count"),
                        v("$.headquarter.city").alias("location"), F.lit("search").alias("source"))
    return F.struct(TX.pystrip(F.concat(v("$.first_name"), F.lit(" "), v("$.last_name"))).alias("name"),
                    v("$.linkedin_profile_url").alias("url"), v("$.headline").alias("headline"), v("$.location").alias("location"),
                    F.lit("search").alias("source"))


def report(df: DataFrame, kind: str, order: list, rows: int = REPORT_ROWS) -> DataFrame:
    """The first ``rows`` rows numbered from 1, with fall-back columns and cut
    widths; columns that ``df`` lacks are empty."""
    def text(n: int, *cols: str) -> Column:
        have = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in cols if c in df.columns]
        return F.substring(F.coalesce(*have, F.lit("")), 1, n)

    if kind == "org":
        cols = {"company": text(40, "name"), "industry": text(35, "industry", "industry_size"),
                "size": text(1000, "employee_count", "company_size_on_linkedin"), "hq": text(25, "headquarters", "location"),
                "website": text(35, "website")}
    else:
        cols = {"name": text(30, "name"), "headline": text(45, "headline", "current_title"), "company": text(25, "current_company"),
                "location": text(20, "location", "country"), "priority": text(1000, "outreach_priority")}
    first = df.orderBy(*order).limit(rows)   # the cut is the feature
    numbered = first.select(F.struct(*order).alias("_o"), *[c.alias(n) for n, c in cols.items()])
    rows_ = numbered.agg(F.array_sort(F.collect_list(F.struct("_o", *cols))).alias("r"))
    return rows_.select(F.posexplode("r").alias("k", "r")).select((F.col("k") + 1).cast("long").alias("no"), *[F.col(f"r.{n}").alias(n) for n in cols])


# --- fixed values: where public profile pages keep their fields, first match counts ---------
PUBLIC_PROFILE = {
    "name": "h1",
    "headline": ".top-card-layout__headline, .pv-text-details__left-panel .text-body-medium, [data-generated-suggestion-target='headline']",
    "location": ".top-card__subline-item, .pv-text-details__left-panel .text-body-small",
    "summary": ".core-section-container__content .pv-shared-text-with-see-more, #about ~ div .visually-hidden, .summary",
}
PUBLIC_EXPERIENCE = ".experience-item, .pvs-list__item--line-separated:first-child"
# ----------------------------------------------------------------------------------------------


def public_profile(dom: D.Dom) -> DataFrame:
    """``page_id, fields``: a MAP of what a public profile page states; fields that are missing or
    empty are left out, the summary is cut at 1000 characters."""
    def text(p: T.Page, e: Column) -> Column:
        return F.coalesce(TX.join_strip(p.deep(e)), F.lit(""))

    def fields(p: T.Page) -> Column:
        found = {k: text(p, RC.first(p.select(sel))) for k, sel in PUBLIC_PROFILE.items()}
        found["summary"] = TX.cut(found["summary"], 1000)
        told = F.array_join(F.transform(F.filter(p.texts, lambda t: F.exists(RC.tagged(p, "body"), lambda b: RC.in_element(b, t["start"]))),
                                        lambda t: t["text"]), " ")
        found["connections"] = F.replace(F.regexp_extract(told, r"(?i)([\d,]+)\s*connections?", 1), F.lit(","), F.lit(""))
        shown = lambda e: F.filter(RC.tagged(p, "span"), lambda x: (x["attrs"]["aria-hidden"] == "true") & RC.in_element(e, x["start"]))
        found["current_title"] = T.let(RC.first(p.select(PUBLIC_EXPERIENCE)), lambda e: text(p, RC.first(shown(e))))
        return F.map_filter(F.create_map(*[x for k, v in found.items() for x in (F.lit(k), v)]), lambda k, v: v != "")

    return RC.parts(dom, fields=fields)
