"""Registered crawl queries (G04-G10) over small sites rendered from ``supplier``."""

from __future__ import annotations

from pyspark.sql import functions as F

from webrel.operators import dom as D
from webrel.operators import graph as G
from webrel.plans import render as R
from webrel.plans.catalog import big, register
from webrel.sources.io import table


def _site(spark, sf):
    pages = R.site_pages(table(spark, sf, "supplier"))
    seeds = pages.filter(F.col("url").endswith(".example.com/")).select("url")
    return pages, seeds


_SITES = """WITH s AS (SELECT s_suppkey AS k, s_nationkey AS nk, s_suppkey // 10 AS b, s_name,
                  'n' || s_nationkey || '-b' || (s_suppkey // 10) || '.example.com' AS host FROM supplier),
m AS (SELECT s.*, row_number() OVER (PARTITION BY host ORDER BY k) AS rn, count(*) OVER (PARTITION BY host) AS n_sup,
             EXISTS (SELECT 1 FROM s s2 WHERE s2.host = s.host AND s2.k = s.k + 1) AS has_next FROM s),
dead AS (SELECT host, k, row_number() OVER (PARTITION BY host ORDER BY k) AS dn, n_sup FROM m WHERE NOT has_next),
v AS (SELECT DISTINCT host, 'http://' || host || '/' AS url, 1 AS rank, 0 AS bfs_depth FROM m
      UNION ALL SELECT host, 'http://' || host || '/s/' || k, 1 + rn, 1 FROM m
      UNION ALL SELECT DISTINCT host, 'http://' || host || '/s/missing', 2 + n_sup, 1 FROM m
      UNION ALL SELECT host, 'http://' || host || '/s/' || (k + 1), 2 + n_sup + dn, 2 FROM dead)
"""


def _visited(spark, sf):
    pages, seeds = _site(spark, sf)
    out = G.crawl(pages, seeds)
    return out["visited"].select("site", "url", big("rank").alias("rank"), big("bfs_depth").alias("bfs_depth"))


register("bfs_rank", _SITES + """
SELECT host AS site, url, rank::BIGINT AS rank, bfs_depth::BIGINT AS bfs_depth FROM v
""")(_visited)


def _sitemap(spark, sf):
    pages, seeds = _site(spark, sf)
    sm = G.crawl(pages, seeds)["sitemap"]
    return sm.select("site", "url", big("rank").alias("rank"), "title",
                     big("internal_links_found").alias("internal_links_found"), big("path_depth").alias("path_depth"))


register("sitemap", _SITES + """
SELECT host AS site, 'http://' || host || '/' AS url, 1::BIGINT AS rank, 'Site ' || host AS title,
       (n_sup + 2)::BIGINT AS internal_links_found, 0::BIGINT AS path_depth FROM m WHERE rn = 1
UNION ALL
SELECT host, 'http://' || host || '/s/' || k, (1 + rn)::BIGINT, s_name,
       1::BIGINT, 1::BIGINT FROM m
""")(_sitemap)


def _errors(spark, sf):
    pages, seeds = _site(spark, sf)
    out = G.crawl(pages, seeds)
    return out["crawl_errors"].select("site", "url", "error")


register("crawl_errors", _SITES + """
SELECT host AS site, url, 'not captured' AS error FROM v WHERE url LIKE '%/s/missing' OR bfs_depth = 2
""")(_errors)


def _stats(spark, sf):
    pages, seeds = _site(spark, sf)
    st = G.crawl(pages, seeds)["stats"]
    return st.select("site", *[big(c).alias(c) for c in ("total_pages", "successful", "errors")])


register("crawl_stats", _SITES + """
SELECT host AS site, count(*)::BIGINT AS total_pages,
       count(*) FILTER (WHERE NOT (url LIKE '%/s/missing' OR bfs_depth = 2))::BIGINT AS successful,
       count(*) FILTER (WHERE url LIKE '%/s/missing' OR bfs_depth = 2)::BIGINT AS errors
FROM v GROUP BY host
""")(_stats)


def _pagination(spark, sf):
    pages, seeds = _site(spark, sf)
    dom = D.parse(pages)
    ch = G.pagination_chain(dom, pages, seeds)
    return ch.select("site", "url", big("rank").alias("rank"))


register("pagination", _SITES + """,
isl AS (SELECT host, k, rn FROM m WHERE k - rn = (SELECT min(k) - 1 FROM m m2 WHERE m2.host = m.host))
SELECT DISTINCT host AS site, 'http://' || host || '/' AS url, 1::BIGINT AS rank FROM m
UNION ALL SELECT host, 'http://' || host || '/s/' || k, (rn + 1)::BIGINT FROM isl
UNION ALL SELECT host, 'http://' || host || '/s/' || (max(k) + 1), (max(rn) + 2)::BIGINT FROM isl GROUP BY host
""")(_pagination)
