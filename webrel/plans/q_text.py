"""Registered text-analytics and link-graph queries over ``documents`` and ``pages``."""

from __future__ import annotations

from pyspark.sql import functions as F

from webrel.functions import text as TX
from webrel.functions import urls as U
from webrel.operators import dom as D
from webrel.operators import graph as G
from webrel.operators import page as P
from webrel.operators.business import dedupe_keep_first
from webrel.plans.catalog import big, register
from webrel.plans.oracle_dom import attr_sql, dom_ctes, q, strip_sql
from webrel.sources.io import table

_EMAIL = TX.EMAIL_RE
_PHONE = r"(\+?\d[\d\s\-\.\(\)]{7,}\d)"
_HOURS_RE2 = (r"(?i)(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun|Monday|Tuesday|Wednesday|Thursday"
              r"|Friday|Saturday|Sunday)[\pL\pN\pM_\s,\-:]+\d{1,2}:\d{2}")


def _docs(spark, sf):
    return table(spark, sf, "documents")


# --- B01 / B02 / B03 contact patterns on documents ------------------------------
def _doc_matches(fn, alias):
    def run(spark, sf):
        d = _docs(spark, sf).select("doc_id", F.explode(fn(F.col("text"))).alias(alias))
        return d.select(big("doc_id").alias("doc_id"), alias)
    return run


register("emails", f"""
SELECT doc_id::BIGINT AS doc_id, unnest(list_distinct(regexp_extract_all(text, {q(_EMAIL)}))) AS email
FROM documents""")(_doc_matches(TX.emails, "email"))

register("phones", f"""
SELECT doc_id::BIGINT AS doc_id, unnest(list_distinct(regexp_extract_all(text, {q(_PHONE)}, 1))) AS phone
FROM documents""")(_doc_matches(TX.phones, "phone"))

register("opening_hours", f"""
SELECT doc_id::BIGINT AS doc_id, unnest(list_distinct(regexp_extract_all(text, {q(_HOURS_RE2)}))) AS hours
FROM documents""")(_doc_matches(TX.opening_hours, "hours"))


# --- B13 keyword_hits -----------------------------------------------------------
def _kw_sql(col: str) -> str:
    return "(" + " OR ".join(f"contains(lower({col}), {q(k)})" for k in TX.PRICE_KEYWORDS) + ")"


register("keyword_hits", f"""
SELECT doc_id::BIGINT AS doc_id, source, {_kw_sql('text')} AS price_keyword FROM documents
""")(lambda spark, sf: _docs(spark, sf).select(
    big("doc_id").alias("doc_id"), "source", TX.has_keyword(F.col("text"), TX.PRICE_KEYWORDS).alias("price_keyword")))


# --- B12 dedupe_first (first document per exact text, in doc_id order) ------------
register("dedupe_first", """
SELECT doc_id::BIGINT AS doc_id, source FROM (
  SELECT doc_id, source, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents)
WHERE rn = 1 OR coalesce(text, '') = ''
""")(lambda spark, sf: dedupe_keep_first(_docs(spark, sf), "text", "doc_id").select(
    big("doc_id").alias("doc_id"), "source"))


# --- word counts (M11 helper) -----------------------------------------------------
register("word_counts", """
SELECT doc_id::BIGINT AS doc_id, len(regexp_extract_all(text, '\\S+'))::BIGINT AS words FROM documents
""")(lambda spark, sf: _docs(spark, sf).select(big("doc_id").alias("doc_id"),
                                              big(TX.word_count(F.col("text"))).alias("words")))


# --- page contacts: e-mails / phones in ``body *::text`` joined by space -----------
def _page_contacts(spark, sf):
    dom = D.parse(table(spark, sf, "pages"))
    bt = P.body_texts(dom).groupBy("page_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]), " ")
        .alias("t"))
    em = bt.select("page_id", F.lit("email").alias("kind"), F.explode(TX.emails(F.col("t"))).alias("value"))
    ph = bt.select("page_id", F.lit("phone").alias("kind"), F.explode(TX.phones(F.col("t"))).alias("value"))
    return em.unionByName(ph).select(big("page_id").alias("page_id"), "kind", "value")


register("page_contacts", f"""WITH {dom_ctes()},
b AS (SELECT page_id, arg_min(start, start) AS bs, arg_min("end", start) AS be FROM el WHERE tag = 'body' GROUP BY page_id),
bt AS (SELECT t.page_id, string_agg(t.text, ' ' ORDER BY t.pos) AS s
       FROM tx t JOIN b ON b.page_id = t.page_id AND b.bs < t.pos AND t.pos < b.be AND t.parent_start <> b.bs
       GROUP BY t.page_id)
SELECT page_id::BIGINT AS page_id, 'email' AS kind, unnest(list_distinct(regexp_extract_all(s, {q(_EMAIL)}))) AS value FROM bt
UNION ALL
SELECT page_id::BIGINT AS page_id, 'phone' AS kind, unnest(list_distinct(regexp_extract_all(s, {q(_PHONE)}, 1))) AS value FROM bt
""")(_page_contacts)


# --- G03 edges ---------------------------------------------------------------------
_NET = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)"


def _edges(spark, sf):
    pages = table(spark, sf, "pages")
    e = G.edges(D.parse(pages), pages)
    return e.select(big("page_id").alias("page_id"), big("pos").alias("pos"), "href", "url", "internal")


_EDGE_SQL = f"""WITH {dom_ctes()},
a AS (SELECT el.page_id, el.start AS pos, coalesce({attr_sql('el.tok', 'href')}, '') AS href, p.url AS page_url
      FROM el JOIN pages p USING (page_id) WHERE el.tag = 'a'),
r AS (SELECT page_id, pos, href, page_url,
        CASE WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN href
             WHEN starts_with(href, '//') THEN regexp_extract(page_url, '^([a-zA-Z][a-zA-Z0-9+.-]*:)', 1) || href
             WHEN starts_with(href, '/') THEN regexp_extract(page_url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) || href
             ELSE NULL END AS u
      FROM a WHERE href <> '' AND NOT (starts_with(href, 'mailto:') OR starts_with(href, 'tel:')
                                       OR starts_with(href, 'javascript:') OR starts_with(href, '#'))),
e AS (SELECT page_id, pos, href, regexp_replace(u, '#.*$', '') AS url,
        regexp_extract(regexp_replace(u, '#.*$', ''), {q(_NET)}, 1) = regexp_extract(page_url, {q(_NET)}, 1) AS internal
      FROM r)
"""

register("edges", _EDGE_SQL + """
SELECT page_id::BIGINT AS page_id, pos::BIGINT AS pos, href, url, internal FROM e
""")(_edges)


# --- G06 dangling links: internal targets missing from the captured pages ------------
def _dangling(spark, sf):
    pages = table(spark, sf, "pages")
    e = G.dangling(G.edges(D.parse(pages), pages), pages)
    return e.groupBy("url").agg(F.count("*").alias("n_links"), F.countDistinct("page_id").alias("n_pages")).select(
        "url", big("n_links").alias("n_links"), big("n_pages").alias("n_pages"))


register("dangling_links", _EDGE_SQL + """
SELECT url, count(*)::BIGINT AS n_links, count(DISTINCT page_id)::BIGINT AS n_pages
FROM e WHERE internal AND url NOT IN (SELECT url FROM pages) GROUP BY url
""")(_dangling)


# --- G11 fetch_class, M01 / S10 / E05 slugs --------------------------------------------
def _fetch_sql() -> str:
    h = f"lower(regexp_extract(url, {q(_NET)}, 1))"
    st = " OR ".join(f"contains({h}, {q(s)})" for s in U.STEALTH_SIGNALS)
    dy = " OR ".join(f"contains({h}, {q(s)})" for s in U.DYNAMIC_SIGNALS)
    return f"CASE WHEN {st} THEN 'stealth' WHEN {dy} THEN 'dynamic' ELSE 'http' END"


register("fetch_class", f"""
SELECT page_id::BIGINT AS page_id, url, {_fetch_sql()} AS strategy FROM pages
""")(lambda spark, sf: table(spark, sf, "pages").select(
    big("page_id").alias("page_id"), "url", U.fetch_class(F.col("url")).alias("strategy")))


def _slugs(spark, sf):
    p = table(spark, sf, "pages")
    return p.select(big("page_id").alias("page_id"), U.snapshot_slug(F.col("url")).alias("snapshot_slug"),
                    U.export_host(F.col("url")).alias("export_host"), U.clean_url(F.col("url")).alias("clean_url"))


_host = f"replace(replace(regexp_extract(url, {q(_NET)}, 1), 'www.', ''), '.', '_')"
_path = "replace(regexp_replace(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '^/+|/+$', '', 'g'), '/', '_')"
register("slugs", f"""
SELECT page_id::BIGINT AS page_id,
       {_host} || '__' || CASE WHEN {_path} = '' THEN 'home' ELSE {_path} END AS snapshot_slug,
       {_host} AS export_host,
       regexp_replace(regexp_replace(url, '\\?.*$', ''), '/$', '') AS clean_url
FROM pages""")(_slugs)
