"""Registered DOM / page-extraction queries over the ``pages`` table."""

from __future__ import annotations

from pyspark.sql import functions as F

from webrel.operators import dom as D
from webrel.operators import page as P
from webrel.plans.catalog import big, register
from webrel.plans.oracle_dom import attr_sql, deep_text_sql, dom_ctes, strip_sql
from webrel.sources.io import table


def _dom(spark, sf_dir):
    return D.parse(table(spark, sf_dir, "pages"))


def _w(body: str) -> str:
    return f"WITH {dom_ctes()}, {body}"


# --- page_headline (flagship) -----------------------------------------------
def page_headline_df(dom: D.Dom):
    """Title, first non-empty h1 and link count per page in ONE elements pass:
    title/h1/a rows, one slice of the page text arrays, one groupBy(page_id).
    (``title`` holds text only - RCDATA - so its first text node is its own.)"""
    from webrel.functions.text import pystrip, strip_join
    e = dom.el.filter(F.col("tag").isin("title", "h1", "a")).select(
        "page_id", "start", "tag", "start_tc", "end_tc", F.col("attrs")["href"].alias("href"))
    e = D.with_text_parts(e, dom)
    h1 = F.when(F.col("tag") == "h1", strip_join(F.col("parts")))
    ti = F.when(F.col("tag") == "title", pystrip(F.coalesce(F.try_element_at("parts", F.lit(1)), F.lit(""))))
    g = e.groupBy("page_id").agg(
        F.min_by(ti, F.when(ti.isNotNull(), F.col("start"))).alias("title"),
        F.min_by(F.when(h1 != "", h1), F.when(h1 != "", F.col("start"))).alias("h1"),
        F.count_if((F.col("tag") == "a") & (F.coalesce("href", F.lit("")) != "")).alias("n_links"))
    pages = dom.txt.select("page_id")
    return (pages.join(g, "page_id", "left")
            .select(big("page_id").alias("page_id"), F.coalesce("title", F.lit("")).alias("title"),
                    F.coalesce("h1", F.lit("")).alias("h1"),
                    F.coalesce(big("n_links"), F.lit(0).cast("bigint")).alias("n_links")))


register("page_headline", _w(f"""
ti AS (SELECT s.page_id, s.start FROM el s WHERE tag = 'title'),
tt AS (SELECT t.page_id, arg_min(t.text, t.pos) AS t FROM tx t JOIN ti ON ti.page_id = t.page_id
       AND t.parent_start = ti.start GROUP BY t.page_id),
h1e AS (SELECT * FROM el WHERE tag = 'h1'),
h1t AS ({deep_text_sql('h1e', mode='strip_join')}),
h1 AS (SELECT page_id, arg_min(text, start) AS h1 FROM h1t WHERE text <> '' GROUP BY page_id),
ae AS (SELECT * FROM el WHERE tag = 'a' AND coalesce({attr_sql('tok', 'href')}, '') <> ''),
nl AS (SELECT page_id, count(*) AS n FROM ae GROUP BY page_id),
pg AS (SELECT DISTINCT page_id FROM tok)
SELECT pg.page_id::BIGINT AS page_id, coalesce({strip_sql('tt.t')}, '') AS title, coalesce(h1.h1, '') AS h1,
       coalesce(nl.n, 0)::BIGINT AS n_links
FROM pg LEFT JOIN tt USING (page_id) LEFT JOIN h1 USING (page_id) LEFT JOIN nl USING (page_id)
"""))(lambda spark, sf: page_headline_df(_dom(spark, sf)))


# --- D01 token_counts --------------------------------------------------------
register("token_counts", _w("""
x AS (SELECT 1)
SELECT page_id::BIGINT AS page_id, kind, count(*)::BIGINT AS n FROM tok GROUP BY page_id, kind
"""))(lambda spark, sf: D.tokenize(table(spark, sf, "pages")).groupBy("page_id", "kind")
      .agg(F.count("*").alias("n")).select(big("page_id").alias("page_id"), "kind", big("n").alias("n")))


# --- D02/D03 element_spans ---------------------------------------------------
def _element_spans(spark, sf):
    e = _dom(spark, sf).elements
    return e.select(big("page_id").alias("page_id"), big("start").alias("start"), big("end").alias("end"), "tag",
                    big("parent_start").alias("parent_start"))


register("element_spans", _w("""
par AS (SELECT c.page_id, c.start, max(p.start) AS parent_start FROM el c LEFT JOIN el p
        ON p.page_id = c.page_id AND p.start < c.start AND c.start < p."end" AND NOT p.void
        GROUP BY c.page_id, c.start)
SELECT el.page_id::BIGINT AS page_id, el.start::BIGINT AS start, el."end"::BIGINT AS "end", el.tag,
       par.parent_start::BIGINT AS parent_start
FROM el JOIN par USING (page_id, start)
"""))(_element_spans)


# --- D04 attrs ----------------------------------------------------------------
def _attrs(spark, sf):
    e = _dom(spark, sf).el
    return e.select("page_id", "start", "tag", F.explode("attrs").alias("name", "value")).select(
        big("page_id").alias("page_id"), big("start").alias("start"), "tag", "name", "value")


register("attrs", _w(f"""
a AS (SELECT page_id, start, tag, tok, unnest(regexp_extract_all(tok, {"'"}\\s([a-zA-Z-]+)\\s*={"'"}, 1)) AS name FROM el)
SELECT page_id::BIGINT AS page_id, start::BIGINT AS start, tag, lower(name) AS name,
       CASE lower(name)
         WHEN 'href' THEN {attr_sql('tok', 'href')} WHEN 'lang' THEN {attr_sql('tok', 'lang')}
         WHEN 'charset' THEN {attr_sql('tok', 'charset')} WHEN 'class' THEN {attr_sql('tok', 'class')}
       END AS value
FROM a
"""))(_attrs)


# --- F03 headings --------------------------------------------------------------
register("headings", _w(f"""
he AS (SELECT * FROM el WHERE tag IN ('h1','h2','h3','h4')),
ht AS ({deep_text_sql('he', mode='strip_join')})
SELECT ht.page_id::BIGINT AS page_id, he.tag AS level, ht.start::BIGINT AS start, ht.text
FROM ht JOIN he USING (page_id, start) WHERE ht.text <> ''
"""))(lambda spark, sf: P.headings(_dom(spark, sf)).select(
    big("page_id").alias("page_id"), "level", big("start").alias("start"), "text"))


# --- F07 links ------------------------------------------------------------------
register("links", _w(f"""
ae AS (SELECT *, {attr_sql('tok', 'href')} AS href FROM el WHERE tag = 'a'),
af AS (SELECT * FROM ae WHERE coalesce(href, '') <> ''),
lt AS ({deep_text_sql('af', mode='join_strip')})
SELECT lt.page_id::BIGINT AS page_id, lt.start::BIGINT AS start, lt.text, af.href
FROM lt JOIN af USING (page_id, start)
"""))(lambda spark, sf: P.links(_dom(spark, sf)).select(
    big("page_id").alias("page_id"), big("start").alias("start"), "text", "href"))


# --- X10 links_first_text -------------------------------------------------------
register("links_first_text", _w(f"""
ae AS (SELECT *, {attr_sql('tok', 'href')} AS href FROM el WHERE tag = 'a'),
af AS (SELECT * FROM ae WHERE coalesce(href, '') <> ''),
lt AS ({deep_text_sql('af', mode='first')})
SELECT lt.page_id::BIGINT AS page_id, lt.start::BIGINT AS start, {strip_sql("lt.text")} AS text,
       {strip_sql('af.href')} AS href
FROM lt JOIN af USING (page_id, start)
"""))(lambda spark, sf: P.links_first_text(_dom(spark, sf)).select(
    big("page_id").alias("page_id"), big("start").alias("start"), "text", "href"))


# --- F05 paragraphs -------------------------------------------------------------
register("paragraphs", _w(f"""
pe AS (SELECT page_id, start FROM el WHERE tag = 'p')
SELECT t.page_id::BIGINT AS page_id, t.pos::BIGINT AS pos, {strip_sql('t.text')} AS text
FROM tx t JOIN pe ON pe.page_id = t.page_id AND pe.start = t.parent_start
WHERE length({strip_sql('t.text')}) > 20
"""))(lambda spark, sf: P.paragraphs(_dom(spark, sf)).select(
    big("page_id").alias("page_id"), big("pos").alias("pos"), "text"))


# --- F06 navigation -------------------------------------------------------------
register("navigation", _w(f"""
ae AS (SELECT *, {attr_sql('tok', 'href')} AS href FROM el WHERE tag = 'a'),
box AS (SELECT * FROM el WHERE tag IN ('nav', 'header')
        OR coalesce({attr_sql('tok', 'class')}, '') LIKE '%nav%'
        OR coalesce({attr_sql('tok', 'class')}, '') LIKE '%menu%'),
na AS (SELECT DISTINCT a.* FROM ae a JOIN box b ON a.page_id = b.page_id AND b.start < a.start AND a.start < b."end"
       WHERE coalesce(a.href, '') <> ''),
nt AS ({deep_text_sql('na', mode='join_strip')})
SELECT nt.page_id::BIGINT AS page_id, nt.start::BIGINT AS start, nt.text, na.href
FROM nt JOIN na USING (page_id, start) WHERE nt.text <> ''
"""))(lambda spark, sf: P.navigation(_dom(spark, sf)).select(
    big("page_id").alias("page_id"), big("start").alias("start"), "text", "href"))


# --- F13 full_text ----------------------------------------------------------------
register("full_text", _w(f"""
b AS (SELECT page_id, arg_min(start, start) AS bs, arg_min("end", start) AS be FROM el WHERE tag = 'body' GROUP BY page_id),
bt AS (SELECT t.page_id, string_agg(CASE WHEN {strip_sql('t.text')} <> '' THEN {strip_sql('t.text')} END, ' '
                                    ORDER BY t.pos) AS s
       FROM tx t JOIN b ON b.page_id = t.page_id AND b.bs < t.pos AND t.pos < b.be AND t.parent_start <> b.bs
       GROUP BY t.page_id),
pg AS (SELECT DISTINCT page_id FROM tok)
SELECT pg.page_id::BIGINT AS page_id,
       {strip_sql("regexp_replace(coalesce(bt.s, ''), '\\s+', ' ', 'g')")} AS full_text
FROM pg LEFT JOIN bt USING (page_id)
"""))(lambda spark, sf: P.full_text(_dom(spark, sf)).select(big("page_id").alias("page_id"), "full_text"))


# --- X09 page_text ------------------------------------------------------------------
register("page_text", _w("""
x AS (SELECT 1)
SELECT page_id::BIGINT AS page_id, pos::BIGINT AS pos, text FROM tx
"""))(lambda spark, sf: P.page_text(_dom(spark, sf)).select(
    big("page_id").alias("page_id"), big("pos").alias("pos"), "text"))


# --- F14 extract_full (record sizes per page) ------------------------------------------
def _full_sizes(spark, sf):
    f = P.extract_full(_dom(spark, sf))
    n = lambda c: big(F.coalesce(F.size(c), F.lit(0))).alias(f"n_{c}")
    return f.select(big("page_id").alias("page_id"), "title", n("headings"), n("paragraphs"), n("navigation"),
                    n("links"), n("images"), big(F.length("full_text")).alias("len_full_text"))


register("extract_full_sizes", _w(f"""
ti AS (SELECT s.page_id, s.start FROM el s WHERE tag = 'title'),
tt AS (SELECT t.page_id, arg_min(t.text, t.pos) AS t FROM tx t JOIN ti ON ti.page_id = t.page_id
       AND t.parent_start = ti.start GROUP BY t.page_id),
he AS (SELECT * FROM el WHERE tag IN ('h1','h2','h3','h4')),
ht AS ({deep_text_sql('he', mode='strip_join')}),
nh AS (SELECT page_id, count(*) AS n FROM ht WHERE text <> '' GROUP BY page_id),
pe AS (SELECT page_id, start FROM el WHERE tag = 'p'),
np AS (SELECT t.page_id, count(*) AS n FROM tx t JOIN pe ON pe.page_id = t.page_id AND pe.start = t.parent_start
       WHERE length({strip_sql('t.text')}) > 20 GROUP BY t.page_id),
ae AS (SELECT *, {attr_sql('tok', 'href')} AS href FROM el WHERE tag = 'a'),
af AS (SELECT * FROM ae WHERE coalesce(href, '') <> ''),
nl AS (SELECT page_id, count(*) AS n FROM af GROUP BY page_id),
box AS (SELECT * FROM el WHERE tag IN ('nav', 'header')
        OR coalesce({attr_sql('tok', 'class')}, '') LIKE '%nav%'
        OR coalesce({attr_sql('tok', 'class')}, '') LIKE '%menu%'),
na AS (SELECT DISTINCT a.* FROM af a JOIN box b ON a.page_id = b.page_id AND b.start < a.start AND a.start < b."end"),
nt AS ({deep_text_sql('na', mode='join_strip')}),
nn AS (SELECT page_id, count(*) AS n FROM nt WHERE text <> '' GROUP BY page_id),
b AS (SELECT page_id, arg_min(start, start) AS bs, arg_min("end", start) AS be FROM el WHERE tag = 'body' GROUP BY page_id),
bt AS (SELECT t.page_id, string_agg(CASE WHEN {strip_sql('t.text')} <> '' THEN {strip_sql('t.text')} END, ' '
                                    ORDER BY t.pos) AS s
       FROM tx t JOIN b ON b.page_id = t.page_id AND b.bs < t.pos AND t.pos < b.be AND t.parent_start <> b.bs
       GROUP BY t.page_id),
pg AS (SELECT DISTINCT page_id FROM tok)
SELECT pg.page_id::BIGINT AS page_id, coalesce({strip_sql('tt.t')}, '') AS title,
       coalesce(nh.n, 0)::BIGINT AS n_headings, coalesce(np.n, 0)::BIGINT AS n_paragraphs,
       coalesce(nn.n, 0)::BIGINT AS n_navigation, coalesce(nl.n, 0)::BIGINT AS n_links, 0::BIGINT AS n_images,
       length({strip_sql("regexp_replace(coalesce(bt.s, ''), '\\s+', ' ', 'g')")})::BIGINT AS len_full_text
FROM pg LEFT JOIN tt USING (page_id) LEFT JOIN nh USING (page_id) LEFT JOIN np USING (page_id)
     LEFT JOIN nn USING (page_id) LEFT JOIN nl USING (page_id) LEFT JOIN bt USING (page_id)
"""))(_full_sizes)
