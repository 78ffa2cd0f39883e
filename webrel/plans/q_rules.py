"""Registered rule-engine queries (X01-X07, X14-X16, X19) over ``pages``."""

from __future__ import annotations

from pyspark.sql import functions as F

from webrel.operators import dom as D
from webrel.operators import rules as RU
from webrel.plans.catalog import big, register
from webrel.plans.oracle_dom import attr_sql, dom_ctes
from webrel.sources.io import table


def _dom(spark, sf):
    return D.parse(table(spark, sf, "pages"))


def _long(df):
    return df.select(big("page_id").alias("page_id"), "field", big("idx").alias("idx"), "value")


_BASE = f"""WITH {dom_ctes()},
own AS (SELECT t.page_id, t.pos, t.text, e.tag, e.start AS el_start
        FROM tx t JOIN el e ON e.page_id = t.page_id AND e.start = t.parent_start),
inside AS (SELECT DISTINCT c.page_id, c.start, p.tag AS anc_tag FROM el c JOIN el p
           ON p.page_id = c.page_id AND p.start < c.start AND c.start < p."end")"""

# --- X01/X02/X04 single-value rules -------------------------------------------------
SINGLE_RULES = [
    {"field": "title", "selector": "title::text"},
    {"field": "h1", "selector": "h1::text"},
    {"field": "lang", "selector": "html::attr(lang)"},
    {"field": "first_link", "selector": "a", "attr": "href"},
]

register("rules_single", _BASE + f""",
r AS (
  SELECT page_id, 'title' AS field, arg_min(text, pos) AS value FROM own WHERE tag = 'title' GROUP BY page_id
  UNION ALL SELECT page_id, 'h1', arg_min(text, pos) FROM own WHERE tag = 'h1' GROUP BY page_id
  UNION ALL SELECT page_id, 'lang', arg_min({attr_sql('tok', 'lang')}, start) FROM el
            WHERE tag = 'html' AND {attr_sql('tok', 'lang')} IS NOT NULL GROUP BY page_id
  UNION ALL SELECT page_id, 'first_link', arg_min({attr_sql('tok', 'href')}, start) FROM el
            WHERE tag = 'a' AND {attr_sql('tok', 'href')} IS NOT NULL GROUP BY page_id)
SELECT page_id::BIGINT AS page_id, field, 0::BIGINT AS idx, value FROM r
""")(lambda spark, sf: _long(RU.extract(_dom(spark, sf), SINGLE_RULES)))

# --- X03 multiple-value rules ----------------------------------------------------------
MULTI_RULES = [
    {"field": "nav_text", "selector": "nav a::text", "multiple": True},
    {"field": "nav_href", "selector": "nav a", "attr": "href", "multiple": True},
    {"field": "ad", "selector": "div.ad::text", "multiple": True},
]

register("rules_multi", _BASE + f""",
r AS (
  SELECT o.page_id, 'nav_text' AS field, o.pos AS k, o.text AS value FROM own o
    JOIN inside i ON i.page_id = o.page_id AND i.start = o.el_start AND i.anc_tag = 'nav' WHERE o.tag = 'a'
  UNION ALL SELECT e.page_id, 'nav_href', e.start, {attr_sql('e.tok', 'href')} FROM el e
    JOIN inside i ON i.page_id = e.page_id AND i.start = e.start AND i.anc_tag = 'nav'
    WHERE e.tag = 'a' AND {attr_sql('e.tok', 'href')} IS NOT NULL
  UNION ALL SELECT o.page_id, 'ad', o.pos, o.text FROM own o JOIN el e ON e.page_id = o.page_id AND e.start = o.el_start
    WHERE o.tag = 'div' AND list_contains(string_split(trim({attr_sql('e.tok', 'class')}), ' '), 'ad'))
SELECT page_id::BIGINT AS page_id, field, (row_number() OVER (PARTITION BY page_id, field ORDER BY k) - 1)::BIGINT AS idx,
       value FROM r
""")(lambda spark, sf: _long(RU.extract(_dom(spark, sf), MULTI_RULES)))

# --- X06 regex post-filter ------------------------------------------------------------------
REGEX_RULES = [
    {"field": "p_word", "selector": "p::text", "multiple": True, "regex": "[A-Za-z]{4,}"},
    {"field": "h1_word", "selector": "h1::text", "regex": "[A-Za-z]+"},
]

register("rules_regex", _BASE + """,
m AS (SELECT page_id, pos, regexp_extract(text, '[A-Za-z]{4,}') AS v FROM own WHERE tag = 'p'),
h AS (SELECT page_id, arg_min(text, pos) AS t FROM own WHERE tag = 'h1' GROUP BY page_id),
r AS (SELECT page_id, 'p_word' AS field, pos AS k, v AS value FROM m WHERE v <> ''
      UNION ALL SELECT page_id, 'h1_word', 0, regexp_extract(t, '[A-Za-z]+') FROM h WHERE regexp_extract(t, '[A-Za-z]+') <> '')
SELECT page_id::BIGINT AS page_id, field, (row_number() OVER (PARTITION BY page_id, field ORDER BY k) - 1)::BIGINT AS idx,
       value FROM r
""")(lambda spark, sf: _long(RU.extract(_dom(spark, sf), REGEX_RULES)))

# --- X05 XPath forms -------------------------------------------------------------------------------
XPATH_RULES = [
    {"field": "h1", "selector": "//h1/text()", "multiple": True},
    {"field": "hrefs", "selector": "//a/@href", "multiple": True},
    {"field": "ad", "selector": '//div[@class="ad"]/text()', "multiple": True},
    {"field": "second_li", "selector": "//li[2]/a/text()", "multiple": True},
    {"field": "the_links", "selector": '//a[contains(text(),"the")]/text()', "multiple": True},
]

register("xpath_forms", _BASE + f""",
li2 AS (SELECT page_id, start, "end" FROM (
          SELECT e.page_id, e.start, e."end", row_number() OVER (PARTITION BY e.page_id, p.parent_start ORDER BY e.start) AS n
          FROM el e JOIN (SELECT c.page_id, c.start, max(q.start) AS parent_start FROM el c JOIN el q
                          ON q.page_id = c.page_id AND q.start < c.start AND c.start < q."end" AND NOT q.void
                          WHERE c.tag = 'li' GROUP BY c.page_id, c.start) p
          ON p.page_id = e.page_id AND p.start = e.start WHERE e.tag = 'li') WHERE n = 2),
r AS (
  SELECT page_id, 'h1' AS field, pos AS k, text AS value FROM own WHERE tag = 'h1'
  UNION ALL SELECT page_id, 'hrefs', start, {attr_sql('tok', 'href')} FROM el WHERE tag = 'a' AND {attr_sql('tok', 'href')} IS NOT NULL
  UNION ALL SELECT o.page_id, 'ad', o.pos, o.text FROM own o JOIN el e ON e.page_id = o.page_id AND e.start = o.el_start
    WHERE o.tag = 'div' AND {attr_sql('e.tok', 'class')} = 'ad'
  UNION ALL SELECT o.page_id, 'second_li', o.pos, o.text FROM own o JOIN el a ON a.page_id = o.page_id AND a.start = o.el_start
    JOIN li2 ON li2.page_id = a.page_id AND li2.start < a.start AND a.start < li2."end"
    WHERE o.tag = 'a' AND a.start = (SELECT min(a2.start) FROM el a2 WHERE a2.page_id = a.page_id AND a2.start > li2.start
                                     AND a2.start < li2."end" AND a2.tag = 'a')
  UNION ALL SELECT o.page_id, 'the_links', o.pos, o.text FROM own o
    WHERE o.tag = 'a' AND contains((SELECT arg_min(o2.text, o2.pos) FROM own o2 WHERE o2.page_id = o.page_id
                                    AND o2.el_start = o.el_start), 'the'))
SELECT page_id::BIGINT AS page_id, field, (row_number() OVER (PARTITION BY page_id, field ORDER BY k) - 1)::BIGINT AS idx,
       value FROM r
""")(lambda spark, sf: _long(RU.extract(_dom(spark, sf), XPATH_RULES)))


# --- X19 spider items ----------------------------------------------------------------------------------
def _items(spark, sf):
    it = RU.spider_items(_dom(spark, sf), {"heading": "h1::text", "links": "nav a::attr(href)"})
    return it.select(big("page_id").alias("page_id"), "field", big(F.size("values")).alias("n_values"),
                     F.coalesce("value", F.lit("<list>")).alias("value"))


register("items", _BASE + f""",
v AS (SELECT page_id, 'heading' AS field, text AS value FROM own WHERE tag = 'h1'
      UNION ALL SELECT e.page_id, 'links', {attr_sql('e.tok', 'href')} FROM el e
        JOIN inside i ON i.page_id = e.page_id AND i.start = e.start AND i.anc_tag = 'nav'
        WHERE e.tag = 'a' AND {attr_sql('e.tok', 'href')} IS NOT NULL)
SELECT page_id::BIGINT AS page_id, field, count(*)::BIGINT AS n_values,
       CASE WHEN count(*) = 1 THEN min(value) ELSE '<list>' END AS value
FROM v GROUP BY page_id, field
""")(_items)


# --- X14 find_by_text ------------------------------------------------------------------------------------
register("find_by_text", _BASE + """,
f AS (SELECT page_id, el_start, arg_min(text, pos) AS first_text, bool_or(contains(text, 'the')) AS hit, min(tag) AS tag
      FROM own GROUP BY page_id, el_start)
SELECT page_id::BIGINT AS page_id, el_start::BIGINT AS start, tag, first_text AS text FROM f WHERE hit
""")(lambda spark, sf: RU.find_by_text(_dom(spark, sf), "the").select(
    big("page_id").alias("page_id"), big("start").alias("start"), "tag", "text"))


# --- X16 preview -------------------------------------------------------------------------------------------
register("preview", _BASE + """,
p AS (SELECT page_id, pos, text FROM own WHERE tag = 'p')
SELECT page_id::BIGINT AS page_id, pos::BIGINT AS pos,
       CASE WHEN length(text) > 120 THEN substring(text, 1, 120) || '...' ELSE text END AS value FROM p
""")(lambda spark, sf: RU.preview(
    RU.items(_dom(spark, sf), [{"field": "p", "selector": "p::text", "multiple": True}])).select(
    big("page_id").alias("page_id"), big("pos.at").alias("pos"), "value"))
