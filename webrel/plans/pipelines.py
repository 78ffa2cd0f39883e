"""Combined pipelines (P01-P04, P06-P09) as DataFrame functions.

Each pipeline returns named DataFrames; every record is one reading of its page,
so nothing is persisted that a caller would have to release.  Writing is the
caller's choice (``sources.io`` writers, partitioned by dataset name, which
also avoids the reference's same-second file-name collisions, Q15).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webrel.operators import business as B
from webrel.operators import changes as C
from webrel.operators import dom as D
from webrel.operators import entities as EN
from webrel.operators import graph as G
from webrel.operators import page as P
from webrel.operators import profiles as PR
from webrel.operators import requests as N


def full_with_monitor(pages: DataFrame, previous: DataFrame | None, ts_col: str = "snapshot_ts") -> dict:
    """Full records + business records, compared with the previous
    snapshots (status + changes); the new snapshots are returned for appending."""
    dom = D.parse(pages)
    snaps = C.snapshot_records(dom, pages, ts_col)
    old = previous if previous is not None else snaps.limit(0)
    status, changes = C.compare(C.latest(old).drop("n_snapshots"), snaps)
    out = {"full": P.extract_full(dom), "business": B.extract_business(dom), "status": status,
           "changes": changes, "snapshots": snaps}
    return out


def crawl_business(pages: DataFrame, seeds: DataFrame, max_pages: int = 0) -> dict:
    """Crawl, then full + business extraction of the crawled pages."""
    res = G.crawl(pages, seeds, max_pages)
    crawled = pages.join(res["visited"].select("url").distinct(), "url", "left_semi")
    dom = D.parse(crawled)
    res["full"] = P.extract_full(dom)
    res["business"] = B.extract_business(dom)
    return res


def deep(pages: DataFrame, requests: DataFrame, responses: DataFrame, ws: DataFrame,
         seeds: DataFrame | None = None, max_pages: int = 10) -> dict:
    """Five outputs: full, business, snapshot, capture stats, crawl."""
    dom = D.parse(pages)
    out = {"full": P.extract_full(dom), "business": B.extract_business(dom),
           "snapshot": C.snapshot_records(dom, pages.withColumn("snapshot_ts", F.current_timestamp())),
           "capture_stats": N.capture_stats(requests, responses, ws)}
    if seeds is not None:
        out["crawl"] = G.crawl(pages, seeds, max_pages, dom)
    return out


def find_orgs(result_pages: DataFrame, count: int | None = None, profiles: DataFrame | None = None, page_col: str | None = None,
              **wanted) -> DataFrame:
    """Cards, or links on pages without a card (E01, E02) -> pages up to the first
    gap where they are numbered (E35) -> filter (E29) -> dedupe (E08) -> first
    ``count`` (E10) -> enrich (E15).  ``PR.report`` prints the first rows (E34)."""
    found = EN.org_search(D.parse(result_pages))
    return _found(found, ["url", "name"], result_pages, count, profiles, page_col, wanted, ("name", "industry_size"), "industry_size")


def find_people(result_pages: DataFrame, count: int | None = None, profiles: DataFrame | None = None, page_col: str | None = None,
                **wanted) -> DataFrame:
    """The same for people (E04, E35, E29, E09, E10, E15), without scoring."""
    found = PR.person_search(D.parse(result_pages))
    keys = [k for k in ("profile_id", "url", "name") if k in found.columns]   # E09
    return _found(found, keys, result_pages, count, profiles, page_col, wanted, ("name", "headline"), "headline")


def _found(found: DataFrame, keys: list[str], pages: DataFrame, count, profiles, page_col, wanted, text_cols, title_col) -> DataFrame:
    found = found.withColumn("pos", F.struct("page_id", "start"))
    if page_col:
        found = found.join(pages.select("page_id", page_col), "page_id")
        found = EN.paged_results(found, page_col, "pos").drop(page_col)
    if wanted:
        found = PR.entity_filter(found, text_cols=text_cols, title_col=title_col, **wanted)
    found = EN.dedupe_entities(found, keys, "pos")
    if count:
        found = EN.top_n(found, "pos", count)
    return EN.enrich(found, profiles, "url") if profiles is not None else found


def recruiting_list(people: DataFrame, count: int, order: str, titles: list[str] | None = None, profiles: DataFrame | None = None,
                    key: str = "profile_url", mode: str = "word", **wanted) -> DataFrame:
    """People with one of ``titles`` (the default recruiting titles), the
    first ``count`` by ``order``, enriched, scored by seniority, highest first;
    ``place`` numbers the list."""
    p = PR.entity_filter(people, titles=PR.RECRUITING_TITLES if titles is None else titles, **wanted)
    p = EN.top_n(p, order, count)
    if profiles is not None:
        p = EN.enrich(p, profiles, key)
    title = F.col("current_title") if "current_title" in p.columns else F.lit("")
    p = p.withColumn("outreach_priority", EN.seniority_score(F.col("headline"), F.coalesce(title, F.lit("")), mode))
    place = F.row_number().over(Window.orderBy(F.col("outreach_priority").desc(), F.col(order)))   # ``count`` rows
    return p.withColumn("place", place)


def entity_api_modes(orgs: DataFrame, people: DataFrame) -> dict[str, DataFrame]:
    """The five modes over payload tables ``(profile_url, payload JSON)``: company
    search, people search (E24), company (E17), person (E20), employees (E18, E28)."""
    o = orgs.select("profile_url", F.try_parse_json("payload").alias("v"))
    p = people.select("profile_url", F.try_parse_json("payload").alias("v"))
    company = o.select(EN.normalize_org(F.col("v"), F.col("profile_url")).alias("r")).select("r.*")
    staff = company.select(F.col("profile_url").alias("org_url"), F.explode("key_employees").alias("e")).select("org_url", "e.*")
    return {"company-search": o.select(PR.search_rows(F.col("v"), "org").alias("r")).select("r.*"),
            "people-search": p.select(PR.search_rows(F.col("v"), "person").alias("r")).select("r.*"),
            "company": company, "person": p.select(EN.normalize_person(F.col("v"), F.col("profile_url")).alias("r")).select("r.*"),
            "employees": staff}


def recruiting(people: DataFrame, profiles: DataFrame, key: str = "profile_url", mode: str = "word") -> DataFrame:
    """Stubs -> enrich -> seniority score -> stable sort."""
    e = EN.enrich(people, profiles, key)
    e = e.withColumn("score", EN.seniority_score(F.col("headline"), F.coalesce(
        F.col("current_title") if "current_title" in e.columns else F.lit(""), F.lit("")), mode))
    return EN.rank_by_score(e, "score", key)
