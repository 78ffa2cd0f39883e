"""Registered extraction queries over rendered pages (FIXTURES.md section 2).

The Spark side parses HTML rendered from a driver table; the oracle reads the
same source table directly and never parses HTML.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from webrel.functions import text as TX
from webrel.operators import business as B
from webrel.operators import dom as D
from webrel.operators import entities as EN
from webrel.operators import page as P
from webrel.operators import record as RC
from webrel.plans import render as R
from webrel.plans.catalog import big, register
from webrel.sources.io import table

PRICE = "'$' || printf('%.2f', p_retailprice)"


def _part_dom(spark, sf):
    return D.parse(R.part_pages(table(spark, sf, "part")), spread=True)


def _supplier_dom(spark, sf):
    return D.parse(R.supplier_pages(table(spark, sf, "supplier"), table(spark, sf, "nation")))


def _pid(c="page_id"):
    return big(c).alias("page_id")


# --- F02 json_ld -----------------------------------------------------------------
register("json_ld", """
SELECT p_partkey::BIGINT AS page_id, p_name AS name, p_partkey::BIGINT AS sku FROM part WHERE p_partkey % 10 <> 0
""")(lambda spark, sf: P.json_ld(_part_dom(spark, sf)).select(
    _pid(), F.variant_get("doc", "$.name", "string").alias("name"), F.variant_get("doc", "$.sku", "bigint").alias("sku")))

# --- X13 page_meta ------------------------------------------------------------------
register("page_meta", """
SELECT p_partkey::BIGINT AS page_id, p_name AS title, p_type || ' part' AS description, p_name AS og_title,
       '' AS og_description, 'https://cdn.example.com/' || p_partkey || '.jpg' AS og_image,
       'https://shop.example.com/part/' || p_partkey AS canonical
FROM part""")(lambda spark, sf: P.page_meta(_part_dom(spark, sf)).select(
    _pid(), "title", "description", "og_title", "og_description", "og_image", "canonical"))

# --- F08 / X11 images ---------------------------------------------------------------
register("images", """
SELECT p_partkey::BIGINT AS page_id, '/img/' || p_partkey || '.jpg' AS src, p_name AS alt FROM part
""")(lambda spark, sf: P.images(_part_dom(spark, sf)).select(_pid(), "src", "alt"))

register("images_basic", """
SELECT p_partkey::BIGINT AS page_id, '/img/' || p_partkey || '.jpg' AS src, p_name AS alt FROM part
WHERE p_partkey % 3 IN (0, 1)
""")(lambda spark, sf: P.images_basic(_part_dom(spark, sf)).select(_pid(), "src", "alt"))


# --- F09 forms --------------------------------------------------------------------------
def _forms(spark, sf):
    f, fields = P.forms(_part_dom(spark, sf), once=True)
    return f.join(fields, ["page_id", "form_start"]).select(_pid(), "action", "method", "type", "name", "placeholder")


register("forms", """
SELECT p_partkey::BIGINT AS page_id, '/cart/' || p_partkey AS action, 'post' AS method, f.type, f.name, f.placeholder
FROM part, (VALUES ('number', 'qty', 'Quantity'), ('hidden', 'sku', ''), ('text', 'note', 'Note')) f(type, name, placeholder)
""")(_forms)

# --- F10 buttons --------------------------------------------------------------------------
register("buttons", """
SELECT p_partkey::BIGINT AS page_id, 'Add to cart' AS text, '' AS href FROM part
""")(lambda spark, sf: P.buttons(_part_dom(spark, sf)).select(_pid(), "text", "href"))

# --- F12 social_links -------------------------------------------------------------------------
register("social_links", """
SELECT p_partkey::BIGINT AS page_id,
       CASE p_partkey % 4 WHEN 0 THEN 'facebook' WHEN 1 THEN 'twitter' ELSE 'x.com' END AS platform,
       lower(CASE p_partkey % 4 WHEN 0 THEN 'https://www.facebook.com/' WHEN 1 THEN 'https://twitter.com/'
             ELSE 'https://www.netflix.com/' END || p_brand) AS href,
       CASE p_partkey % 4 WHEN 0 THEN 'Facebook' WHEN 1 THEN 'Twitter  ' || p_brand ELSE 'Watch' END AS text
FROM part WHERE p_partkey % 4 <> 3
""")(lambda spark, sf: P.social_links(_part_dom(spark, sf), "substring").select(_pid(), "platform", "href", "text"))

# --- F11 tables ---------------------------------------------------------------------------------
register("tables", """
SELECT p_partkey::BIGINT AS page_id, 1::BIGINT AS row_no, c.col_no::BIGINT AS col_no, c.header,
       CASE c.col_no WHEN 0 THEN p_brand WHEN 1 THEN p_type ELSE p_size::VARCHAR END AS value
FROM part, (VALUES (0, 'Brand'), (1, 'Type'), (2, 'Size')) c(col_no, header)
""")(lambda spark, sf: P.table_rows(_part_dom(spark, sf)).select(
    _pid(), big("row_no").alias("row_no"), big("col_no").alias("col_no"), "header", "value"))

# --- X12 table_rows_basic -------------------------------------------------------------------------
register("table_rows_basic", """
SELECT p_partkey::BIGINT AS page_id, c.col_no::BIGINT AS col_no, c.header AS key,
       CASE c.col_no WHEN 0 THEN p_brand WHEN 1 THEN p_type ELSE p_size::VARCHAR END AS value
FROM part, (VALUES (0, 'Brand'), (1, 'Type'), (2, 'Size')) c(col_no, header)
""")(lambda spark, sf: P.table_rows_basic(_part_dom(spark, sf)).select(
    _pid(), big("col_no").alias("col_no"), "key", "value"))


# --- F04 sections -------------------------------------------------------------------------------------
def _sections(spark, sf):
    secs, _ = P.sections(_part_dom(spark, sf))
    return secs.select(_pid(), "heading", F.array_join("texts", " | ").alias("content"))


register("sections", f"""
SELECT p_partkey::BIGINT AS page_id, p_name AS heading,
       CASE WHEN p_partkey % 7 = 0 THEN {PRICE} || ' one-time' ELSE {PRICE} END
       || ' | Size ' || p_size || ' ' || p_name || ' for everyday work' AS content
FROM part""")(_sections)

# --- B04 / B05 pricing -----------------------------------------------------------------------------------
register("pricing", f"""
SELECT p_partkey::BIGINT AS page_id,
       CASE WHEN p_partkey % 7 = 0 THEN 'fee-box' ELSE p_brand END AS label,
       {PRICE} AS prices,
       CASE WHEN p_partkey % 7 = 0 THEN 'Fee ' || {PRICE} || ' one-time'
            ELSE p_brand || ' ' || {PRICE} || ' per month' END AS text
FROM part""")(lambda spark, sf: B.rows(_part_dom(spark, sf), B.pricing).select(
    _pid(), "label", F.array_join("prices_found", ",").alias("prices"), "text"))

# --- B06 services ----------------------------------------------------------------------------------------------
register("services", """
SELECT p_partkey::BIGINT AS page_id, p_type AS name, 'Size ' || p_size || ' ' || p_name || ' for everyday work' AS description
FROM part""")(lambda spark, sf: B.rows(_part_dom(spark, sf), B.services).select(_pid(), "name", "description"))

# --- B10 locations (supplier pages) ------------------------------------------------------------------------------
_SUP = "supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey"
register("locations", f"""
SELECT s_suppkey::BIGINT AS page_id, s_suppkey || ' Market Street, ' || coalesce(n_name, '') AS location FROM {_SUP}
UNION ALL
SELECT s_suppkey::BIGINT AS page_id, 'Office ' || coalesce(n_name, '') || ' branch ' || s_suppkey AS location FROM {_SUP}
""")(lambda spark, sf: B.rows(_supplier_dom(spark, sf), B.locations).select(_pid(), F.col("value").alias("location")))

# --- B03 hours on supplier pages -----------------------------------------------------------------------------------
register("page_hours", """
SELECT s_suppkey::BIGINT AS page_id, 'Mon-Fri 09:00 - 17:00' AS hours FROM supplier
""")(lambda spark, sf: D.exploded(RC.parts(_supplier_dom(spark, sf), c=B.contact), "c.hours", "hours").select(_pid(), "hours"))

# --- E11 / E12 org details --------------------------------------------------------------------------------------------
register("org_details", f"""
SELECT s_suppkey::BIGINT AS page_id, coalesce(n_name, '') AS headquarters, (1990 + s_suppkey % 30)::VARCHAR AS founded,
       'Wholesale' AS industry
FROM {_SUP}""")(lambda spark, sf: EN.org_details(_supplier_dom(spark, sf)).select(
    _pid(), "headquarters", "founded", "industry"))

# --- E01 / E03 org cards ------------------------------------------------------------------------------------------------
register("org_cards", """
SELECT s_suppkey::BIGINT AS page_id, s_name AS name, 'https://www.linkedin.com/company/supplier-' || s_suppkey AS url,
       'Wholesale · ' || (s_suppkey % 500 + 11) || ' employees' AS industry_size, coalesce(n_name, '') AS location
FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey WHERE s_suppkey % 2 = 0
""")(lambda spark, sf: EN.org_cards(_supplier_dom(spark, sf)).select(_pid(), "name", "url", "industry_size",
                                                                    "location"))


# --- B07 team (team pages) -------------------------------------------------------------------------------------------------
def _team(spark, sf):
    dom = D.parse(R.team_pages(table(spark, sf, "customer")))
    return B.rows(dom, B.team).select(_pid(), "name", "role", "bio", "photo")


register("team", """
WITH c AS (SELECT c_custkey AS k, (c_custkey // 20)::BIGINT AS page_id,
                  CASE WHEN c_custkey % 7 = 3 THEN '' ELSE c_name END AS name, c_mktsegment AS role,
                  'Balance ' || printf('%.2f', c_acctbal) AS bio, '/people/' || c_custkey || '.jpg' AS photo
           FROM customer)
SELECT page_id, name, role, bio, photo FROM c
UNION ALL SELECT page_id, name, role, bio, photo FROM c WHERE name = '' AND k % 5 = 0
""")(_team)


# --- B09 faqs / B08 testimonials (conversation pages) ------------------------------------------------------------------------
def _talk_dom(spark, sf):
    return D.parse(R.talk_pages(table(spark, sf, "conversations")))


_TALK = """
WITH c AS (SELECT conv_id, turn, role, text,
                  lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nr,
                  lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nt FROM conversations),
u AS (SELECT (conv_id * 2147483648 + turn)::BIGINT AS page_id, conv_id,
             regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS q,
             regexp_replace(CASE WHEN nr = 'assistant' THEN nt ELSE '' END, '^\\s+|\\s+$', '', 'g') AS a
      FROM c WHERE role = 'user')
"""

register("faqs", _TALK + """
SELECT page_id, substring(q, 1, 200) AS question, substring(a, 1, 400) AS answer FROM u WHERE q <> ''
""")(lambda spark, sf: B.rows(_talk_dom(spark, sf), B.faqs).select(_pid(), "question", "answer"))

register("testimonials", _TALK + """, t AS (
SELECT page_id, CASE WHEN q <> '' THEN q || ' ' ELSE '' END || 'User ' || conv_id AS txt, 'User ' || conv_id AS author FROM u)
SELECT page_id, substring(txt, 1, 400) AS text, author FROM t WHERE length(txt) >= 20
""")(lambda spark, sf: B.rows(_talk_dom(spark, sf), B.testimonials).select(_pid(), "text", "author"))


# --- B11 key stats (order stats pages) ------------------------------------------------------------------------------------------
register("key_stats", """
WITH g AS (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS mx FROM orders GROUP BY o_custkey)
SELECT o_custkey::BIGINT AS page_id, n::VARCHAR AS number, n::VARCHAR AS label FROM g, range(3)
UNION ALL
SELECT o_custkey::BIGINT AS page_id, printf('%.2f', mx) AS number, 'Total spent' AS label FROM g
""")(lambda spark, sf: B.rows(D.parse(R.stat_pages(table(spark, sf, "orders"))), B.key_stats).select(
    _pid(), "number", "label"))


# --- B15 price values (ours): money text -> DECIMAL + currency ---------------------------
def _price_values(spark, sf):
    p = D.exploded(B.rows(_part_dom(spark, sf), B.pricing), "prices_found", "price")
    v = p.select(_pid(), "price", B.price_value(F.col("price")).alias("v"))
    return v.select("page_id", "price", F.col("v.amount").cast("string").alias("amount"), F.col("v.currency").alias("currency"))


register("price_values", f"""
SELECT p_partkey::BIGINT AS page_id, {PRICE} AS price, printf('%.2f', p_retailprice) AS amount, 'USD' AS currency
FROM part""")(_price_values)


# --- E01 + E02 organisation search: cards, link-scan fallback elsewhere --------------------
register("org_search", """
SELECT s_suppkey::BIGINT AS page_id, s_name AS name, 'https://www.linkedin.com/company/supplier-' || s_suppkey AS url,
       CASE WHEN s_suppkey % 2 = 0 THEN 'Wholesale · ' || (s_suppkey % 500 + 11) || ' employees'
            ELSE s_name || ' Wholesale Follow ' || coalesce(n_name, '') END AS industry_size,
       CASE WHEN s_suppkey % 2 = 0 THEN coalesce(n_name, '') ELSE 'Wholesale' END AS location,
       CASE WHEN s_suppkey % 2 = 0 THEN 'card' ELSE 'link_scan' END AS source
FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey
""")(lambda spark, sf: EN.org_search(_supplier_dom(spark, sf)).select(
    _pid(), "name", "url", "industry_size", "location", "source"))
