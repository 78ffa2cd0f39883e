"""Registered queries over whole records: the full and the business record of a page
(F14, B14), price changes (M10), organisation records and the API modes (E17-E20, E24,
E28, P08).  Nested parts are compared as JSON text, with the order of their items."""

from __future__ import annotations

from pyspark.sql import functions as F

from webrel.operators import business as B
from webrel.operators import changes as C
from webrel.operators import dom as D
from webrel.operators import entities as EN
from webrel.operators import page as P
from webrel.operators import rules as RU
from webrel.plans import pipelines as PL
from webrel.plans import render as R
from webrel.plans.catalog import big, register
from webrel.sources.io import table


def _as_text(df, *keep):
    """Nested columns as JSON text."""
    nested = ("array", "struct", "map")
    kept = ["page_id"] if keep else []
    return df.select(*keep, *[(F.to_json(F.col(f.name)) if f.dataType.typeName() in nested else F.col(f.name)).alias(f.name)
                              for f in df.schema.fields if f.name not in kept])


_PRICE = "'$' || printf('%.2f', p_retailprice)"
_PART = f"""WITH p AS (SELECT *, p_partkey AS k, {_PRICE} AS price, p_partkey % 7 = 0 AS fee, p_partkey % 4 AS s,
    'Size ' || p_size || ' ' || p_name || ' for everyday work' AS sentence, lower(p_brand) AS low FROM part),
x AS (SELECT *, CASE s WHEN 0 THEN '{{"text":"Facebook","href":"https://www.facebook.com/' || p_brand || '"}}'
                       WHEN 1 THEN '{{"text":"Twitter  ' || p_brand || '","href":"https://twitter.com/' || p_brand || '"}}'
                       WHEN 2 THEN '{{"text":"Watch","href":"https://www.netflix.com/' || p_brand || '"}}' END AS anchor,
    CASE s WHEN 0 THEN ' Facebook' WHEN 1 THEN ' Twitter ' || p_brand WHEN 2 THEN ' Watch' ELSE '' END AS shown FROM p)
"""

register("extract_full", _PART + """
SELECT k::BIGINT AS page_id, p_name AS title,
  CASE WHEN k % 10 = 0 THEN '[]' ELSE '[{"@type":"Product","brand":"' || p_brand || '","name":"' || p_name || '","sku":' || k || '}]' END AS structured_data,
  '[{"level":"h1","text":"' || p_name || '"},{"level":"h2","text":"' || CASE WHEN fee THEN 'Fee' ELSE p_brand END
     || '"},{"level":"h3","text":"' || p_type || '"}]' AS headings,
  '[{"heading":"' || p_name || '","content":["' || price || CASE WHEN fee THEN ' one-time' ELSE '' END || '","' || sentence || '"]}]' AS sections,
  '[' || CASE WHEN fee AND length(price || ' one-time') > 20 THEN '"' || price || ' one-time",' ELSE '' END || '"' || sentence || '"]' AS paragraphs,
  '[{"text":"Home","href":"/"},{"text":"Parts","href":"/parts"}]' AS navigation,
  '[{"text":"Home","href":"/"},{"text":"Parts","href":"/parts"}' || coalesce(',' || anchor, '') || ']' AS links,
  '[{"src":"/img/' || k || '.jpg","alt":"' || p_name || '"}]' AS images,
  '[{"action":"/cart/' || k || '","method":"post","fields":[{"type":"number","name":"qty","placeholder":"Quantity"},'
     || '{"type":"hidden","name":"sku","placeholder":""},{"type":"text","name":"note","placeholder":"Note"}]}]' AS forms,
  '[{"text":"Add to cart","href":""}]' AS buttons_cta,
  '[{"rows":[{"Brand":"' || p_brand || '","Type":"' || p_type || '","Size":"' || p_size || '"}]}]' AS tables,
  CASE s WHEN 0 THEN '[{"platform":"facebook","href":"https://www.facebook.com/' || low || '","text":"Facebook"}]'
         WHEN 1 THEN '[{"platform":"twitter","href":"https://twitter.com/' || low || '","text":"Twitter  ' || p_brand || '"}]' ELSE '[]' END AS social_links,
  'Home Parts ' || p_name || ' ' || CASE WHEN fee THEN 'Fee ' || price || ' one-time' ELSE p_brand || ' ' || price || ' per month' END || ' ' || p_type
     || ' ' || sentence || ' Brand Type Size ' || p_brand || ' ' || p_type || ' ' || p_size || ' Add to cart' || shown || ' Parts & more' AS full_text
FROM x""")(lambda spark, sf: _as_text(P.extract_full(D.parse(R.part_pages(table(spark, sf, "part")), spread=True)), big("page_id").alias("page_id")))

register("extract_business", _PART + """
SELECT k::BIGINT AS page_id, '{"emails":[],"phones":[],"hours":[]}' AS contact,
  CASE WHEN fee THEN '[{"label":"fee-box","prices_found":["' || price || '"],"text":"Fee ' || price || ' one-time"}]'
       ELSE '[{"label":"' || p_brand || '","prices_found":["' || price || '"],"text":"' || p_brand || ' ' || price || ' per month"}]' END AS pricing,
  '[{"name":"' || p_type || '","description":"' || sentence || '"}]' AS services,
  '[]' AS team, '[]' AS testimonials, '[]' AS faqs, '[]' AS locations, '[]' AS stats
FROM x""")(lambda spark, sf: _as_text(B.extract_business(D.parse(R.part_pages(table(spark, sf, "part")), spread=True)), big("page_id").alias("page_id")))


def _price_changes(spark, sf):
    """Two captures of the part pages; every third part costs one more in the second."""
    part = table(spark, sf, "part")
    dearer = part.withColumn("p_retailprice", F.when(F.col("p_partkey") % 3 == 0, F.col("p_retailprice") + 1).otherwise(F.col("p_retailprice")))
    shots = [C.snapshot_records(D.parse(v), v) for v in (
        R.part_pages(df).withColumn("snapshot_ts", F.lit(day).cast("timestamp")) for df, day in ((part, "2024-01-01"), (dearer, "2024-01-02")))]
    _, changes = C.compare(*shots)
    return changes.select("url", "type", "value")


register("price_changes", """
SELECT 'https://shop.example.com/part/' || p_partkey AS url, t.type,
       '$' || printf('%.2f', CASE WHEN t.type = 'price_added' THEN p_retailprice + 1 ELSE p_retailprice END) AS value
FROM part, (VALUES ('price_added'), ('price_removed')) t(type) WHERE p_partkey % 3 = 0
""")(_price_changes)


# --- organisations and persons -------------------------------------------------------------
_ORG = "supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey"
_EMPLOYEES = """'[' || list_aggregate(list_transform(range(0, least(s_suppkey % 13 + 1, 10)), lambda i:
    '{"name":"Emp' || s_suppkey || '_' || i || ' Lastname","title":"Role ' || i || '","profile_url":"https://people.example.com/in/e' || s_suppkey || '-' || i || '"}'),
    'string_agg', ',') || ']'"""
_ROUNDS = """CASE WHEN s_suppkey % 4 <> 0 THEN '{"total_raised":' || (s_suppkey * 1000 * (s_suppkey % 3 + 1)) || ',"rounds":[' ||
    list_aggregate(list_transform(range(1, s_suppkey % 3 + 2), lambda i: '{"type":"' || ['Seed', 'Series A', 'Series B'][i] || '","amount":' || (s_suppkey * 1000 * i)
      || ',"year":' || (2010 + s_suppkey % 10 + i) || ',"investors":["Fund ' || i || '"],"amount_text":"' || (s_suppkey * 1000 * i) || '"}'), 'string_agg', ',') || ']}' END"""
_COMPANY = f"""
SELECT s_name AS name, 'https://www.linkedin.com/company/s' || s_suppkey AS profile_url, 'https://s' || s_suppkey || '.example.com' AS website,
  'Supplier in ' || coalesce(n_name, '') AS description, CASE WHEN s_suppkey % 3 = 0 THEN 'Trade' ELSE 'Wholesale' END AS industry,
  CASE WHEN s_suppkey % 3 = 0 THEN '[]' ELSE '["Wholesale","Logistics"]' END AS industries, '["parts","supply"]' AS specialties,
  (s_suppkey % 500 + 11)::VARCHAR AS employee_count,
  CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE concat_ws(', ', 'City' || (s_suppkey % 50), nullif(coalesce(n_name, ''), '')) END AS headquarters,
  (1990 + s_suppkey % 30)::VARCHAR AS founded, CASE WHEN s_suppkey % 2 = 0 THEN 'Privately Held' ELSE '' END AS company_type,
  (s_suppkey * 37 % 10000)::VARCHAR AS follower_count, s_suppkey::VARCHAR AS linkedin_id, 'Tagline ' || s_suppkey AS tagline,
  {_EMPLOYEES} AS key_employees, {_ROUNDS} AS funding, 'company_payload' AS source
FROM {_ORG}"""


def _modes(spark, sf, mode):
    orgs = R.org_payloads(table(spark, sf, "supplier"), table(spark, sf, "nation"))
    people = R.person_payloads(table(spark, sf, "customer"))
    return _as_text(PL.entity_api_modes(orgs.select("profile_url", "payload"), people.select("profile_url", "payload"))[mode])


register("api_company", _COMPANY)(lambda spark, sf: _modes(spark, sf, "company"))
register("api_company_search", """
SELECT s_name AS name, '' AS url, 'https://s' || s_suppkey || '.example.com' AS website, 'Trade' AS industry,
       (s_suppkey % 500 + 11)::VARCHAR AS employee_count, '' AS location, 'search' AS source FROM supplier
""")(lambda spark, sf: _modes(spark, sf, "company-search"))

_PERSON_NAME = "trim('First' || c_custkey || ' ' || CASE WHEN c_custkey % 9 = 0 THEN '' ELSE 'Last' || c_custkey END)"


def _headline_sql() -> str:
    quoted = ", ".join("'" + h.replace("'", "''") + "'" for h in R.HEADLINES)
    return f"[{quoted}][(c_custkey % {len(R.HEADLINES)}) + 1]"


register("api_people_search", f"""
SELECT {_PERSON_NAME} AS name, '' AS url, {_headline_sql()} AS headline, '' AS location, 'search' AS source FROM customer
""")(lambda spark, sf: _modes(spark, sf, "people-search"))

register("api_person", f"""
SELECT {_PERSON_NAME} AS name, 'First' || c_custkey AS first_name, CASE WHEN c_custkey % 9 = 0 THEN '' ELSE 'Last' || c_custkey END AS last_name,
  'https://people.example.com/in/c' || c_custkey AS profile_url, {_headline_sql()} AS headline, '' AS summary,
  CASE WHEN c_custkey % 4 = 0 THEN 'Testland' ELSE 'City' || (c_custkey % 50) END AS location, 'Testland' AS country,
  'Title0' AS current_title, 'Co' || (c_custkey % 17) AS current_company,
  CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'c' || c_custkey || '@example.com' END AS email, '' AS phone,
  CASE WHEN c_custkey % 2 = 0 THEN '["sql","python"]' ELSE '[]' END AS skills,
  '[' || list_aggregate(list_transform(range(0, c_custkey % 4 + 1), lambda i: '{{"title":"Title' || i || '","company":"Co' || (c_custkey % 17) || '","location":"","start":"'
     || (2000 + i) || '-' || (i % 12 + 1) || '","end":"' || CASE WHEN i = 0 THEN 'Present' ELSE (2001 + i)::VARCHAR END
     || '","description":"' || substring(repeat('desc ', i * 40), 1, 300) || '"}}'), 'string_agg', ',') || ']' AS experience,
  CASE WHEN c_custkey % 3 = 0 THEN '[]' ELSE '[' || list_aggregate(list_transform(range(1, c_custkey % 3 + 1), lambda i:
     '{{"school":"School' || i || '","degree":"BSc","field":"Physics","end_year":' || (1990 + i) || '}}'), 'string_agg', ',') || ']' END AS education
FROM customer""")(lambda spark, sf: _modes(spark, sf, "person"))

register("api_employees", f"""
SELECT 'https://www.linkedin.com/company/s' || s_suppkey AS org_url, 'Emp' || s_suppkey || '_' || e.i || ' Lastname' AS name, 'Role ' || e.i AS title,
       'https://people.example.com/in/e' || s_suppkey || '-' || e.i AS profile_url
FROM {_ORG}, range(0, 10) e(i) WHERE e.i < least(s_suppkey % 13 + 1, 10)
""")(lambda spark, sf: _modes(spark, sf, "employees"))

register("first_employees", """
SELECT c_custkey::BIGINT AS c_custkey, c_name AS name, c_mktsegment AS title FROM customer
WHERE c_nationkey = 7 AND contains(lower(c_mktsegment), 'build') ORDER BY c_custkey LIMIT 5
""")(lambda spark, sf: EN.employees_of(table(spark, sf, "customer"), 7, "Build", count=5).select(
    big("c_custkey").alias("c_custkey"), "name", "title"))

register("social_links_by_host", """
SELECT p_partkey::BIGINT AS page_id, CASE p_partkey % 4 WHEN 0 THEN 'facebook' ELSE 'twitter' END AS platform,
       lower(CASE p_partkey % 4 WHEN 0 THEN 'https://www.facebook.com/' ELSE 'https://twitter.com/' END || p_brand) AS href,
       CASE p_partkey % 4 WHEN 0 THEN 'Facebook' ELSE 'Twitter  ' || p_brand END AS text
FROM part WHERE p_partkey % 4 < 2
""")(lambda spark, sf: P.social_links(D.parse(R.part_pages(table(spark, sf, "part")), spread=True)).select(
    big("page_id").alias("page_id"), "platform", "href", "text"))


def _selectors(spark, sf):
    dom = D.parse(R.part_pages(table(spark, sf, "part")))
    rows = None
    for text in ("Add to cart", "for everyday work", "Parts"):
        found = RU.selector_for(dom, text).select(big("page_id").alias("page_id"), F.lit(text).alias("text"), "selector")
        rows = found if rows is None else rows.unionByName(found)
    return rows


register("selector_for", """
SELECT p_partkey::BIGINT AS page_id, t.text, CASE t.text WHEN 'Add to cart' THEN 'button:nth-of-type(1)'
       WHEN 'Parts' THEN 'a:nth-of-type(2)'
       ELSE CASE WHEN p_partkey % 7 = 0 THEN 'div:nth-of-type(2) > ' ELSE '' END || 'p:nth-of-type(1)' END AS selector
FROM part, (VALUES ('Add to cart'), ('for everyday work'), ('Parts')) t(text)
""")(_selectors)
