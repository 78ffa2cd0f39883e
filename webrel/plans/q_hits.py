"""Registered queries over nested search, profile and position payloads and public
profile pages (E14, E25-E27).
The payloads are rendered from ``customer`` in every shape the operators accept; the
SQL reads the table alone."""

from __future__ import annotations

from pyspark.sql import functions as F

from webrel.operators import dom as D
from webrel.operators import hits as H
from webrel.operators import profiles as PR
from webrel.plans.catalog import big, register
from webrel.sources.io import table

PAGE = 8   # customers in a search payload


def _text(c) -> F.Column:
    return F.struct(c.alias("text"))


def _json(*pairs) -> F.Column:
    return F.to_json(F.struct(*[c.alias(k) for k, c in pairs]))


def search_payloads(customer):
    """One payload per ``PAGE`` customers: the first four as hits of one group, the others
    as groups of their own, between them values that are no groups or no hits."""
    k, n = F.col("c_custkey"), F.col("c_name")
    name = F.when(k % 11 == 0, F.lit("LinkedIn Member")).when(k % 13 == 0, F.lit("")).otherwise(n)
    told = F.when(k % 5 == 0, F.array(
        F.struct(F.struct(_text(F.lit("")).alias("title")).alias("lockupViewModel")),
        F.struct(F.struct(_text(F.concat(F.lit("Told "), k.cast("string"))).alias("title")).alias("lockupViewModel"))))
    path = F.concat(F.lit("/in/c"), k.cast("string"))
    entity = [
        ("title", F.when(k % 3 == 0, _text(name))), ("firstName", F.when(k % 3 == 1, name)),
        ("primaryText", F.when(k % 3 == 2, _text(F.when(name == n, F.concat(F.lit(" "), n)).otherwise(name)))),
        ("primarySubtitle", F.when(k % 2 == 0, _text(F.col("c_mktsegment")))), ("subtitle", _text(F.lower("c_mktsegment"))),
        ("secondarySubtitle", F.when(k % 7 != 0, _text(F.concat(F.lit("Nation "), F.col("c_nationkey").cast("string"))))),
        ("navigationUrl", F.when(k % 4 < 2, path)), ("url", F.when(k % 4 == 2, F.concat(F.lit("https://x.example.com"), path))),
        ("trackingUrn", F.when(k % 6 == 0, F.concat(F.lit("urn:li:member:"), k.cast("string")))),
        ("insightViewModel", F.when(told.isNotNull(), F.struct(told.alias("insightComponents")))),
    ]
    own = F.struct(*[c.alias(a) for a, c in entity])
    outer = ("trackingUrn", F.when(k % 6 == 3, F.concat(F.lit("urn:li:fs:member:"), k.cast("string"), F.lit(",x"))))
    shape = k % 4
    hit = (F.when(shape == 0, _json(("entityResult", own), outer))
           .when(shape == 1, _json(("entityResult", F.struct()), ("member", own), outer))
           .when(shape == 2, _json(("entityLockupView", own), outer))
           .otherwise(F.to_json(own)))
    page = customer.select((k / PAGE).cast("bigint").alias("page_id"), (k % PAGE).alias("at"), hit.alias("hit"))
    page = page.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("at", "hit"))).alias("hits"))   # at most PAGE
    first = F.concat(F.lit('{"elements": ['), F.array_join(F.transform(F.filter("hits", lambda h: h["at"] < 4), lambda h: h["hit"]), ', "no hit", '),
                     F.lit("]}"))
    rest = F.transform(F.filter("hits", lambda h: h["at"] >= 4), lambda h: h["hit"])
    groups = F.concat(F.lit("["), F.array_join(F.concat(F.array(F.lit("7"), first, F.lit('{"elements": []}')), rest), ", "), F.lit("]"))
    return page.select("page_id", F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('{"data": {"elements": '), groups, F.lit("}}")))
                       .otherwise(F.concat(F.lit('{"data": {"elements": []}, "elements": '), groups, F.lit("}"))).alias("json"))


_HITS = """
WITH c AS (
  SELECT *, c_custkey // 8 AS page_id, c_custkey % 8 AS seat,
         row_number() OVER (PARTITION BY c_custkey // 8, c_custkey % 8 < 4 ORDER BY c_custkey) - 1 AS place FROM customer)
SELECT page_id::BIGINT AS page_id, (CASE WHEN seat < 4 THEN 1 ELSE 3 + place END)::BIGINT AS group_no,
       (CASE WHEN seat < 4 THEN 2 * place ELSE 0 END)::BIGINT AS hit_no,
       CASE WHEN c_custkey % 6 = 0 OR c_custkey % 6 = 3 AND c_custkey % 4 <> 3 THEN c_custkey::VARCHAR ELSE '' END AS profile_id, c_name AS name,
       CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE lower(c_mktsegment) END AS headline,
       CASE WHEN c_custkey % 7 <> 0 THEN 'Nation ' || c_nationkey ELSE '' END AS location,
       CASE c_custkey % 4 WHEN 2 THEN 'https://x.example.com/in/c' || c_custkey WHEN 3 THEN '' ELSE 'https://www.linkedin.com/in/c' || c_custkey END AS profile_url,
       CASE WHEN c_custkey % 5 = 0 THEN 'Told ' || c_custkey ELSE '' END AS snippet, 'nested_search' AS source
FROM c WHERE c_custkey % 11 <> 0 AND c_custkey % 13 <> 0
"""


def _nested_hits(spark, sf):
    pages = search_payloads(table(spark, sf, "customer"))
    out = H.nested_search_hits(pages.select("page_id", F.try_parse_json("json").alias("payload")))
    return out.withColumns({c: big(c) for c in ("page_id", "group_no", "hit_no")})


register("nested_search_hits", _HITS)(_nested_hits)


def _profile_fields(spark, sf):
    k = F.col("c_custkey")
    js = _json(("firstName", F.col("c_name")), ("lastName", F.when(k % 3 == 0, F.col("c_mktsegment"))),
               ("headline", F.when(k % 2 == 0, F.lit("")).otherwise(F.lit("Head"))),
               ("locationName", F.when(k % 4 == 0, F.lit("Here"))), ("geoLocationName", F.lit("There")),
               ("connectionsCount", k % 3), ("geoRegionName", F.when(k % 5 == 0, F.col("c_nationkey").cast("string"))))
    rows = table(spark, sf, "customer").select("c_custkey", F.explode(F.map_entries(H.profile_fields(F.try_parse_json(js)))).alias("e"))
    return rows.select(big("c_custkey").alias("c_custkey"), F.col("e.key").alias("field"), F.col("e.value").alias("value"))


register("profile_fields", """
WITH f AS (SELECT c_custkey, unnest([
    {'field': 'first_name', 'value': c_name}, {'field': 'last_name', 'value': CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END},
    {'field': 'name', 'value': c_name || CASE WHEN c_custkey % 3 = 0 THEN ' ' || c_mktsegment ELSE '' END},
    {'field': 'headline', 'value': CASE WHEN c_custkey % 2 = 1 THEN 'Head' END},
    {'field': 'location', 'value': CASE WHEN c_custkey % 4 = 0 THEN 'Here' ELSE 'There' END},
    {'field': 'connections', 'value': (c_custkey % 3)::VARCHAR},
    {'field': 'country', 'value': CASE WHEN c_custkey % 5 = 0 THEN c_nationkey::VARCHAR END}]) AS e FROM customer)
SELECT c_custkey::BIGINT AS c_custkey, e.field AS field, e.value AS value FROM f WHERE e.value IS NOT NULL
""")(_profile_fields)


def _positions(spark, sf):
    """Orders as positions: a customer's latest ten at most, each of three shapes."""
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    body = F.struct(F.when(k % 7 != 0, _text(F.col("o_orderpriority"))).alias("title"),
                    F.when(k % 2 == 0, _text(F.col("o_orderstatus"))).alias("subtitle"),
                    _text(F.date_format("o_orderdate", "yyyy-MM")).alias("metadata"),
                    F.when(k % 3 == 0, _text(F.repeat(F.concat(k.cast("string"), F.lit(" ")), 100))).alias("description"))
    js = F.when(k % 4 == 0, F.to_json(F.struct(body.alias("entityLockupView")))).otherwise(F.to_json(body))
    lists = o.filter(k % 5 != 0).select(F.col("o_orderkey").alias("doc"), js.alias("js"))
    wrapped = F.when(F.col("doc") % 2 == 0, F.concat(F.lit('{"elements": [3, '), F.col("js"), F.lit(", "), F.col("js"), F.lit("]}"))) \
        .otherwise(F.concat(F.lit('{"elements": [], "data": {"elements": ['), F.col("js"), F.lit("]}}")))
    out = H.position_rows(lists.select("doc", F.try_parse_json(wrapped).alias("payload")))
    return out.withColumns({c: big(c) for c in ("doc", "position_no")})


register("position_rows", """
WITH o AS (SELECT *, unnest(CASE WHEN o_orderkey % 2 = 0 THEN [1, 2] ELSE [0] END) AS position_no FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0)
SELECT o_orderkey::BIGINT AS doc, position_no::BIGINT AS position_no, o_orderpriority AS title,
       CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE '' END AS company, strftime(o_orderdate, '%Y-%m') AS date_range,
       CASE WHEN o_orderkey % 3 = 0 THEN left(repeat(o_orderkey || ' ', 100), 300) ELSE '' END AS description
FROM o
""")(_positions)


def _public_profiles(spark, sf):
    k, n = F.col("c_custkey"), F.col("c_name")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    head = F.when(k % 3 == 0, text('<h2 class="x top-card-layout__headline">', F.col("c_mktsegment"), "</h2>")).when(
        k % 3 == 1, text("<p data-generated-suggestion-target='headline'> At <b>", F.col("c_mktsegment"), "</b></p>")).otherwise(F.lit(""))
    about = F.when(k % 2 == 0, text('<div id="about"></div><div><span class="visually-hidden">About ', F.repeat(F.concat(k.cast("string"), F.lit(" ")), 300),
                                    "</span></div>")).otherwise(text('<p class="summary">Short ', k.cast("string"), "</p>"))
    html = text("<html><head><title>9 connections</title></head><body><main><h1>", n, "</h1>", head,
                F.when(k % 4 != 0, text('<span class="top-card__subline-item">Nation ', F.col("c_nationkey").cast("string"), "</span>")).otherwise(F.lit("")),
                about, F.when(k % 5 != 0, text("<p>1,", F.lpad((k % 1000).cast("string"), 3, "0"), " connections</p>")).otherwise(F.lit("")),
                '<ul><li class="pvs-list__item--line-separated"><span>no</span><span aria-hidden="true">Title <i>', (k % 9).cast("string"),
                '</i></span></li><li class="pvs-list__item--line-separated"><span aria-hidden="true">Old</span></li></ul></main></body></html>')
    pages = table(spark, sf, "customer").select(k.alias("page_id"), html.alias("html"))
    rows = PR.public_profile(D.parse(pages)).select("page_id", F.explode(F.map_entries("fields")).alias("e"))
    return rows.select(big("page_id").alias("page_id"), F.col("e.key").alias("field"), F.col("e.value").alias("value"))


register("public_profile", """
WITH f AS (SELECT c_custkey AS k, unnest([
    {'field': 'name', 'value': c_name},
    {'field': 'headline', 'value': CASE c_custkey % 3 WHEN 0 THEN c_mktsegment WHEN 1 THEN 'At  ' || c_mktsegment END},
    {'field': 'location', 'value': CASE WHEN c_custkey % 4 <> 0 THEN 'Nation ' || c_nationkey END},
    {'field': 'summary', 'value': CASE WHEN c_custkey % 2 = 0 THEN left(trim('About ' || repeat(c_custkey || ' ', 300)), 1000) ELSE 'Short ' || c_custkey END},
    {'field': 'connections', 'value': CASE WHEN c_custkey % 5 <> 0 THEN '1' || lpad((c_custkey % 1000)::VARCHAR, 3, '0') END},
    {'field': 'current_title', 'value': 'Title  ' || (c_custkey % 9)}]) AS e FROM customer)
SELECT k::BIGINT AS page_id, e.field AS field, e.value AS value FROM f WHERE e.value IS NOT NULL
""")(_public_profiles)
