"""Registered queries over profile and result pages, filters, search rows and
reports (E04, E11, E13, E24, E29, E33, E34) and the pipelines that combine them
(P06-P09)."""

from __future__ import annotations

from pyspark.sql import functions as F

from webrel.operators import dom as D
from webrel.operators import profiles as PR
from webrel.plans import pipelines as PL
from webrel.plans import render as R
from webrel.plans.catalog import big, register
from webrel.plans.q_entities import _hl_sql, _score_sql
from webrel.sources.io import table


def _org_profile(spark, sf):
    pages = R.org_profile_pages(table(spark, sf, "supplier"), table(spark, sf, "nation"))
    return PR.org_profile(D.parse(pages), pages).select(
        big("page_id").alias("page_id"), "name", "description", "website", "headquarters", "founded", "industry",
        big("followers").alias("followers"), "employee_count", F.array_join("specialties", "|").alias("specialties"))


register("org_profile", """
SELECT s_suppkey::BIGINT AS page_id, s_name AS name,
       CASE WHEN s_suppkey % 4 = 3 THEN '' ELSE 'Makes ' || (s_suppkey % 7) || ' things & more' END AS description,
       CASE WHEN s_suppkey % 2 = 0 THEN 'https://s' || s_suppkey || '.example.com/' ELSE '' END AS website,
       n_name AS headquarters, (1950 + s_suppkey % 60)::VARCHAR AS founded, 'Trade' AS industry,
       (s_suppkey * 1234)::BIGINT AS followers,
       CASE WHEN s_suppkey % 2 = 0 THEN '51-200 employees' ELSE '1,000+ employees' END AS employee_count,
       CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE 'tools|parts ' || (s_suppkey % 5) || '|trade' END AS specialties
FROM supplier JOIN nation ON s_nationkey = n_nationkey
""")(_org_profile)


def _person_profile(spark, sf):
    pages = R.person_profile_pages(table(spark, sf, "customer"))
    x = F.transform("experience", lambda e: F.concat_ws("/", e["title"], e["company"], e["date_range"]))
    return PR.person_profile(D.parse(pages)).select(
        big("page_id").alias("page_id"), "name", "headline", "location", "summary", "connections", "current_title",
        "current_company", F.array_join(x, "|").alias("experience"))


register("person_profile", """
SELECT c_custkey::BIGINT AS page_id, c_name AS name,
       CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE lower(c_mktsegment) END AS headline,
       CASE WHEN c_custkey % 3 = 0 THEN 'Nation ' || c_nationkey ELSE '' END AS location,
       CASE WHEN c_custkey % 4 = 0 THEN 'About ' ELSE 'Sum ' END || c_custkey AS summary,
       (c_custkey * 7)::VARCHAR AS connections, 'Title 1' AS current_title, 'Co ' || (c_custkey % 17) AS current_company,
       list_aggregate(list_transform(list_filter(range(1, least(c_custkey % 12 + 1, 10) + 1), lambda i: i % 4 <> 3),
         lambda i: 'Title ' || i || '/Co ' || (c_custkey % 17) || '/20' || (10 + i)), 'string_agg', '|') AS experience
FROM customer
""")(_person_profile)

_PEOPLE = """SELECT c_custkey, (c_custkey // 8)::BIGINT AS page_id, c_name AS name, 'https://www.linkedin.com/in/c' || c_custkey AS url,
       c_mktsegment AS headline, 'Nation ' || c_nationkey AS location,
       CASE WHEN c_custkey // 8 % 2 = 0 THEN 'dom_card' ELSE 'dom_link' END AS source FROM customer"""


def _person_search(spark, sf):
    dom = D.parse(R.person_result_pages(table(spark, sf, "customer")))
    return PR.person_search(dom).select(big("page_id").alias("page_id"), "name", "url", "headline", "location", "source")


register("person_search", f"SELECT page_id, name, url, headline, location, source FROM ({_PEOPLE})")(_person_search)


def _held_people(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", F.col("c_name").alias("name"), R.headline(F.col("c_custkey")).alias("headline"),
                    F.lower("c_mktsegment").alias("industry"), (F.col("c_custkey") % 5).cast("string").alias("seniority"),
                    F.when(F.col("c_nationkey") % 2 == 0, "usa").otherwise("spain").alias("location"),
                    (F.col("c_custkey") % 1000).alias("employees"))


register("entity_filter", f"""
SELECT c_custkey::BIGINT AS c_custkey, {_hl_sql('c_custkey')} AS headline FROM customer
WHERE contains(c_name, '1') AND (contains(lower({_hl_sql('c_custkey')}), 'founder') OR contains(lower({_hl_sql('c_custkey')}), 'director'))
  AND c_mktsegment IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE') AND c_custkey % 5 IN (1, 2, 3) AND c_nationkey % 2 = 0
  AND c_custkey % 1000 BETWEEN 10 AND 800
""")(lambda spark, sf: PR.entity_filter(
    _held_people(spark, sf), "customer 1", ["Founder", "Director", "no such title", "Coordinator"], ["building", "Machinery", "cars"],
    ["low", "2", "3"], "us", 10, 800, industry_codes={"cars": "automobile"}, seniority_codes={"low": "1"}, geo_codes={"us": "usa"})
    .select(big("c_custkey").alias("c_custkey"), "headline"))


def _results(spark, sf):
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    j = s.join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    hq = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit('"'), "n_name", F.lit('"'))).otherwise(
        F.concat(F.lit('{"city": "'), "n_name", F.lit('"}')))
    js = F.concat(F.lit('{"name": "'), "s_name", F.lit('", "linkedin_profile_url": "https://x/'), F.col("s_suppkey").cast("string"),
                  F.lit('", "company_size_on_linkedin": '), (F.col("s_suppkey") % 900).cast("string"), F.lit(', "headquarter": '), hq, F.lit("}"))
    return j.select("s_suppkey", PR.search_rows(F.try_parse_json(js), "org").alias("r"))


register("org_search_rows", """
SELECT s_suppkey::BIGINT AS s_suppkey, s_name AS name, 'https://x/' || s_suppkey AS url, (s_suppkey % 900)::VARCHAR AS employee_count,
       CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE n_name END AS location
FROM supplier JOIN nation ON s_nationkey = n_nationkey
""")(lambda spark, sf: _results(spark, sf).select(
    big("s_suppkey").alias("s_suppkey"), "r.name", "r.url", "r.employee_count", "r.location"))

register("person_search_rows", """
SELECT c_custkey::BIGINT AS c_custkey, trim('First' || c_custkey || ' ' || CASE WHEN c_custkey % 9 = 0 THEN '' ELSE 'Last' || c_custkey END) AS name,
       'search' AS source FROM customer
""")(lambda spark, sf: R.person_payloads(table(spark, sf, "customer")).select(
    "c_custkey", PR.search_rows(F.try_parse_json("payload"), "person").alias("r")).select(
    big("c_custkey").alias("c_custkey"), "r.name", "r.source"))

register("person_report", f"""
SELECT row_number() OVER (ORDER BY c_custkey)::BIGINT AS no, left(c_name, 30) AS name, left({_hl_sql('c_custkey')}, 45) AS headline,
       '' AS company, left(CASE WHEN c_nationkey % 2 = 0 THEN 'usa' ELSE 'spain' END, 20) AS location, '' AS priority
FROM customer ORDER BY c_custkey LIMIT 20
""")(lambda spark, sf: PR.report(_held_people(spark, sf), "person", ["c_custkey"]))


# --- pipelines -----------------------------------------------------------------------------
register("find_people", f"""
SELECT name, url, headline, location FROM ({_PEOPLE}) WHERE headline IN ('BUILDING', 'MACHINERY') ORDER BY page_id, c_custkey LIMIT 25
""")(lambda spark, sf: PL.find_people(R.person_result_pages(table(spark, sf, "customer")), 25, titles=["building", "machinery"])
     .select("name", "url", "headline", "location"))

register("find_orgs", """
SELECT s_name AS name, 'https://www.linkedin.com/company/supplier-' || s_suppkey AS url FROM supplier
""")(lambda spark, sf: PL.find_orgs(R.supplier_pages(table(spark, sf, "supplier"), table(spark, sf, "nation"))).select("name", "url"))

register("recruiting_list", f"""
WITH p AS (SELECT c_custkey, c_name AS name, {_hl_sql('c_custkey')} AS headline, ({_score_sql('word')})::BIGINT AS score FROM customer),
f AS (SELECT * FROM p WHERE contains(lower(headline), 'cto') OR contains(lower(headline), 'founder') OR contains(lower(headline), 'ceo'))
SELECT row_number() OVER (ORDER BY score DESC, c_custkey)::BIGINT AS place, name, score AS outreach_priority FROM (
  SELECT * FROM f ORDER BY c_custkey LIMIT 40)
""")(lambda spark, sf: PL.recruiting_list(_held_people(spark, sf), 40, "c_custkey").select(
    big("place").alias("place"), "name", big("outreach_priority").alias("outreach_priority")))


def _api_modes(spark, sf):
    orgs = R.org_payloads(table(spark, sf, "supplier"), table(spark, sf, "nation"))
    people = R.person_payloads(table(spark, sf, "customer"))
    out = PL.entity_api_modes(orgs.select("profile_url", "payload"), people.select("profile_url", "payload"))
    rows = None
    for mode in ("company-search", "people-search", "company", "person", "employees"):
        r = out[mode].agg(F.lit(mode).alias("mode"), F.count("*").alias("n"), F.min("name").alias("first_name"), F.max("name").alias("last_name"))
        rows = r if rows is None else rows.unionByName(r)
    return rows


_NAME = "trim('First' || c_custkey || ' ' || CASE WHEN c_custkey % 9 = 0 THEN '' ELSE 'Last' || c_custkey END)"
register("api_modes", f"""
SELECT 'company-search' AS mode, count(*)::BIGINT AS n, min(s_name) AS first_name, max(s_name) AS last_name FROM supplier
UNION ALL SELECT 'people-search', count(*), min({_NAME}), max({_NAME}) FROM customer
UNION ALL SELECT 'company', count(*), min(s_name), max(s_name) FROM supplier
UNION ALL SELECT 'person', count(*), min({_NAME}), max({_NAME}) FROM customer
UNION ALL SELECT 'employees', sum(n)::BIGINT, min(f), max(l) FROM (
  SELECT least(s_suppkey % 13 + 1, 10) AS n, 'Emp' || s_suppkey || '_0 Lastname' AS f,
         'Emp' || s_suppkey || '_' || (least(s_suppkey % 13 + 1, 10) - 1) || ' Lastname' AS l FROM supplier)
""")(_api_modes)
