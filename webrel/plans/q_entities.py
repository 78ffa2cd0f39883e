"""Registered entity queries: payload normalisation, enrichment, de-duplication
and seniority scoring over payloads rendered from supplier / customer."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from webrel.functions import urls as U
from webrel.operators import entities as EN
from webrel.plans import render as R
from webrel.plans.catalog import big, register
from webrel.plans.oracle_dom import q
from webrel.sources.io import table


def _orgs(spark, sf):
    p = R.org_payloads(table(spark, sf, "supplier"), table(spark, sf, "nation"))
    return p.select("s_suppkey", EN.normalize_org(F.try_parse_json("payload"), F.col("profile_url")).alias("o"))


def _people(spark, sf):
    p = R.person_payloads(table(spark, sf, "customer")).select("c_custkey", "profile_url", F.try_parse_json("payload").alias("v"))
    return p.select("c_custkey", EN.normalize_person(F.col("v"), F.col("profile_url")).alias("p"))


_SUP = "supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey"

# --- E17 / E18 organisation normalisation ------------------------------------------
register("org_normalize", f"""
SELECT s_suppkey::BIGINT AS s_suppkey, s_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'Trade' ELSE 'Wholesale' END AS industry,
       CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE concat_ws(', ', nullif('City' || (s_suppkey % 50), ''),
                                                         nullif(coalesce(n_name, ''), '')) END AS headquarters,
       least(s_suppkey % 13 + 1, 10)::BIGINT AS n_key_employees,
       'Emp' || s_suppkey || '_0 Lastname' AS first_employee
FROM {_SUP}""")(lambda spark, sf: _orgs(spark, sf).select(
    big("s_suppkey").alias("s_suppkey"), F.col("o.name").alias("name"), F.col("o.industry").alias("industry"),
    F.col("o.headquarters").alias("headquarters"), big(F.size("o.key_employees")).alias("n_key_employees"),
    F.col("o.key_employees")[0]["name"].alias("first_employee")))


# --- E19 funding rounds -------------------------------------------------------------------
register("funding_rounds", """
SELECT s_suppkey::BIGINT AS s_suppkey, r.i::BIGINT AS round_no,
       CASE r.i WHEN 1 THEN 'Seed' WHEN 2 THEN 'Series A' ELSE 'Series B' END AS type,
       (s_suppkey * 1000 * r.i)::BIGINT AS amount, (2010 + s_suppkey % 10 + r.i)::BIGINT AS year,
       'Fund ' || r.i AS investor, (s_suppkey * 1000 * (s_suppkey % 3 + 1))::BIGINT AS total_raised
FROM supplier, range(1, 4) r(i) WHERE s_suppkey % 4 <> 0 AND r.i <= s_suppkey % 3 + 1
""")(lambda spark, sf: _orgs(spark, sf).filter(F.col("o.funding").isNotNull()).select(
    "s_suppkey", F.col("o.funding.total_raised").alias("total_raised"),
    F.posexplode("o.funding.rounds").alias("i", "r")).select(
    big("s_suppkey").alias("s_suppkey"), big(F.col("i") + 1).alias("round_no"), F.col("r.type").alias("type"),
    big("r.amount").alias("amount"), big("r.year").alias("year"), F.col("r.investors")[0].alias("investor"),
    big("total_raised").alias("total_raised")))


# --- E20 person normalisation ------------------------------------------------------------------
def _hl_sql(col: str) -> str:
    items = ", ".join(q(h) for h in R.HEADLINES)
    return f"[{items}][({col} % {len(R.HEADLINES)}) + 1]"


register("person_normalize", f"""
SELECT c_custkey::BIGINT AS c_custkey,
       trim('First' || c_custkey || ' ' || CASE WHEN c_custkey % 9 = 0 THEN '' ELSE 'Last' || c_custkey END) AS name,
       {_hl_sql('c_custkey')} AS headline,
       CASE WHEN c_custkey % 4 = 0 THEN 'Testland' ELSE 'City' || (c_custkey % 50) END AS location,
       'Title0' AS current_title, 'Co' || (c_custkey % 17) AS current_company,
       CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'c' || c_custkey || '@example.com' END AS email,
       (CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 0 END)::BIGINT AS n_skills
FROM customer""")(lambda spark, sf: _people(spark, sf).select(
    big("c_custkey").alias("c_custkey"), *[F.col(f"p.{c}").alias(c) for c in
                                           ("name", "headline", "location", "current_title", "current_company",
                                            "email")], big(F.size("p.skills")).alias("n_skills")))


# --- E21 experience rows --------------------------------------------------------------------------
register("experience_rows", """
SELECT c_custkey::BIGINT AS c_custkey, r.i::BIGINT AS idx, 'Title' || r.i AS title, 'Co' || (c_custkey % 17) AS company,
       (2000 + r.i) || '-' || (r.i % 12 + 1) AS start,
       CASE WHEN r.i = 0 THEN 'Present' ELSE (2001 + r.i)::VARCHAR END AS "end",
       substring(repeat('desc ', r.i * 40), 1, 300) AS description
FROM customer, range(0, 4) r(i) WHERE r.i <= c_custkey % 4
""")(lambda spark, sf: _people(spark, sf).select("c_custkey", F.posexplode("p.experience").alias("i", "x")).select(
    big("c_custkey").alias("c_custkey"), big("i").alias("idx"), F.col("x.title").alias("title"),
    F.col("x.company").alias("company"), F.col("x.start").alias("start"), F.col("x.end").alias("end"),
    F.col("x.description").alias("description")))


# --- E22 education rows / E23 skills -----------------------------------------------------------------
register("education_rows", """
SELECT c_custkey::BIGINT AS c_custkey, 'School' || r.i AS school, 'BSc' AS degree, 'Physics' AS field,
       (1990 + r.i)::BIGINT AS end_year
FROM customer, range(1, 3) r(i) WHERE c_custkey % 3 <> 0 AND r.i <= c_custkey % 3
""")(lambda spark, sf: _people(spark, sf).select("c_custkey", F.explode("p.education").alias("e")).select(
    big("c_custkey").alias("c_custkey"), F.col("e.school").alias("school"), F.col("e.degree").alias("degree"),
    F.col("e.field").alias("field"), big("e.end_year").alias("end_year")))

register("skills", """
SELECT c_custkey::BIGINT AS c_custkey, unnest(['sql', 'python']) AS skill FROM customer WHERE c_custkey % 2 = 0
""")(lambda spark, sf: _people(spark, sf).select(big("c_custkey").alias("c_custkey"),
                                                F.explode("p.skills").alias("skill")))


# --- E31 seniority score (both modes) ---------------------------------------------------------------------
def _score_sql(mode: str) -> str:
    order = list(EN.SENIORITY_SCORE)
    if mode == "word":
        order.remove(("vice president", 8))
        order.insert(order.index(("president", 9)), ("vice president", 8))
    h = f"lower({_hl_sql('c_custkey')})"
    parts = []
    for kw, sc in order:
        if mode == "word":
            parts.append(f"WHEN regexp_matches({h}, {q('(^|[^a-z0-9_-])' + kw + '([^a-z0-9_-]|$)')}) THEN {sc}")
        else:
            parts.append(f"WHEN contains({h}, {q(kw)}) THEN {sc}")
    return "CASE " + " ".join(parts) + " ELSE 1 END"


for _mode in ("word", "substring"):
    register(f"score_{_mode}", f"""
SELECT c_custkey::BIGINT AS c_custkey, {_hl_sql('c_custkey')} AS headline, ({_score_sql(_mode)})::BIGINT AS score
FROM customer""")(lambda spark, sf, mode=_mode: table(spark, sf, "customer").select(
        big("c_custkey").alias("c_custkey"), R.headline(F.col("c_custkey")).alias("headline"),
        big(EN.seniority_score(R.headline(F.col("c_custkey")), F.lit(""), mode)).alias("score")))


# --- E15 enrich + E33 recruiting list ---------------------------------------------------------------------
def _enriched(spark, sf):
    c = table(spark, sf, "customer")
    stubs = c.select("c_custkey", F.col("c_name").alias("name"), F.lit("").alias("headline"),
                     F.concat(F.lit("https://people.example.com/in/c"), F.col("c_custkey").cast("string"))
                     .alias("profile_url"), F.lit("").alias("location"))
    prof = _people(spark, sf).select(F.col("p.profile_url").alias("profile_url"), F.col("p.name").alias("name"),
                                     F.col("p.headline").alias("headline"), F.col("p.location").alias("location"))
    return EN.enrich(stubs, prof, "profile_url")


register("enrich", f"""
SELECT c_custkey::BIGINT AS c_custkey,
       trim('First' || c_custkey || ' ' || CASE WHEN c_custkey % 9 = 0 THEN '' ELSE 'Last' || c_custkey END) AS name,
       {_hl_sql('c_custkey')} AS headline,
       CASE WHEN c_custkey % 4 = 0 THEN 'Testland' ELSE 'City' || (c_custkey % 50) END AS location
FROM customer""")(lambda spark, sf: _enriched(spark, sf).select(
    big("c_custkey").alias("c_custkey"), "name", "headline", "location"))


def _recruiting(spark, sf):
    e = _enriched(spark, sf).join(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_custkey")
    e = e.filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    e = e.withColumn("score", EN.seniority_score(F.col("headline"), F.lit(""), "word"))
    return EN.rank_by_score(e, "score", "c_custkey").select(
        big("c_custkey").alias("c_custkey"), "name", big("score").alias("score"),
        big("outreach_priority").alias("outreach_priority"))


register("recruiting", f"""
SELECT c_custkey::BIGINT AS c_custkey,
       trim('First' || c_custkey || ' ' || CASE WHEN c_custkey % 9 = 0 THEN '' ELSE 'Last' || c_custkey END) AS name,
       ({_score_sql('word')})::BIGINT AS score, ({_score_sql('word')})::BIGINT AS outreach_priority
FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')""")(_recruiting)


# --- E08 org dedupe / E10 top-n / E30 code lookup / E36 profile url ---------------------------------------
def _org_stubs(spark, sf):
    s = table(spark, sf, "supplier")
    url = F.when(F.col("s_suppkey") % 3 == 0, F.lit("")).otherwise(
        F.concat(F.lit("https://www.linkedin.com/company/s"), (F.col("s_suppkey") / 2).cast("bigint").cast("string")))
    return s.select("s_suppkey", F.col("s_name").alias("name"), url.alias("url"))


register("dedupe_org", """
WITH s AS (SELECT s_suppkey, s_name AS name,
                  CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'https://www.linkedin.com/company/s' || (s_suppkey // 2) END AS url
           FROM supplier),
k AS (SELECT *, coalesce(nullif(url, ''), nullif(lower(trim(name)), '')) AS key FROM s)
SELECT s_suppkey::BIGINT AS s_suppkey, name, url FROM (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY s_suppkey) AS rn FROM k WHERE key IS NOT NULL) WHERE rn = 1
""")(lambda spark, sf: EN.dedupe_entities(_org_stubs(spark, sf), ["url", "name"], "s_suppkey").select(
    big("s_suppkey").alias("s_suppkey"), "name", "url"))

register("top_customers", """
SELECT c_custkey::BIGINT AS c_custkey, c_name AS name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10
""")(lambda spark, sf: EN.top_n(table(spark, sf, "customer").withColumn("neg", -F.col("c_acctbal")),
                                 ["neg", "c_custkey"], 10).select(big("c_custkey").alias("c_custkey"),
                                                                  F.col("c_name").alias("name")))

_GEO_SQL = "CASE " + " ".join(f"WHEN key = {q(k)} THEN {q(v)}" for k, v in EN.GEO_URNS.items()) + " ELSE key END"
register("code_lookup", f"""
WITH c AS (SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN 'usa' WHEN 1 THEN 'spain' ELSE lower(c_mktsegment) END AS key
           FROM customer)
SELECT c_custkey::BIGINT AS c_custkey, key, {_GEO_SQL} AS code FROM c
""")(lambda spark, sf: table(spark, sf, "customer").select(
    big("c_custkey").alias("c_custkey"),
    F.when(F.col("c_custkey") % 7 == 0, "usa").when(F.col("c_custkey") % 7 == 1, "spain")
    .otherwise(F.lower("c_mktsegment")).alias("key")).withColumn("code", EN.code_lookup(F.col("key"), EN.GEO_URNS)))

register("profile_urls", """
SELECT c_custkey::BIGINT AS c_custkey,
       CASE WHEN c_custkey % 2 = 0 THEN 'https://x.example.com/in/c' || c_custkey
            ELSE 'https://people.example.com/in/' || 'c' || c_custkey END AS url
FROM customer""")(lambda spark, sf: table(spark, sf, "customer").select(
    big("c_custkey").alias("c_custkey"), U.profile_url(
        F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("https://x.example.com/in/c"), F.col("c_custkey")))
        .otherwise(F.concat(F.lit("c"), F.col("c_custkey"))), "https://people.example.com/in/").alias("url")))


# --- E28 / E29 employees of a nation filtered by role keyword -----------------------------------------------
register("employees_of", """
SELECT c_custkey::BIGINT AS c_custkey, c_name AS name, c_mktsegment AS title FROM customer
WHERE c_nationkey = 1 AND contains(lower(c_mktsegment), 'build')
""")(lambda spark, sf: EN.employees_of(table(spark, sf, "customer"), 1, "build").select(
    big("c_custkey").alias("c_custkey"), "name", "title"))


# --- E35 paged results: stop at the first empty page -------------------------------------------------------
register("paged_results", """
SELECT o_orderkey::BIGINT AS o_orderkey FROM orders WHERE o_orderkey // 100 < 4
""")(lambda spark, sf: EN.paged_results(
    table(spark, sf, "orders").filter((F.col("o_orderkey") / 100).cast("bigint") != 4)
    .withColumn("page_no", (F.col("o_orderkey") / 100).cast("bigint") + 1), "page_no", "o_orderkey")
    .select(big("o_orderkey").alias("o_orderkey")))
