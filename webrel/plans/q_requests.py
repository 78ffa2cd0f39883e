"""Registered request-log queries over logs rendered from ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from webrel.operators import requests as N
from webrel.plans import render as R
from webrel.plans.catalog import big, register
from webrel.plans.oracle_dom import q
from webrel.sources.io import table


def _logs(spark, sf):
    return R.capture_log(table(spark, sf, "events"))


_RQ = f"""WITH rq AS (
  SELECT event_id, ts, event_type AS t, user_id,
    CASE event_type WHEN 'click' THEN 'https://api.example.com/v1/items/' || user_id
                    WHEN 'view' THEN 'https://www.example.com/page/' || user_id
                    WHEN 'purchase' THEN 'https://shop.example.com/api/cart'
                    WHEN 'signup' THEN 'https://www.example.com/graphql'
                    ELSE 'https://www.example.com/log' END AS url,
    CASE WHEN event_type IN ('click', 'view') THEN 'GET' ELSE 'POST' END AS method,
    CASE event_type WHEN 'click' THEN 'xhr' WHEN 'view' THEN 'document' WHEN 'purchase' THEN 'fetch'
                    WHEN 'signup' THEN 'fetch' ELSE 'other' END AS rtype,
    CASE event_type WHEN 'purchase' THEN '{{"user": ' || user_id || ', "value": ' || printf('%.2f', value) || '}}'
                    WHEN 'signup' THEN '{{"operationName": "Signup", "query": "mutation Signup {{ create(id: ' || user_id
                                       || ') {{ id }} }}", "variables": {{"id": ' || user_id || '}}}}'
                    WHEN 'error' THEN '{{bad json ' || event_id END AS post_data,
    CASE WHEN event_id % 10 = 0 THEN 404 WHEN event_id % 10 = 1 THEN 500 ELSE 200 END AS status,
    CASE event_type WHEN 'view' THEN 'text/html' WHEN 'signup' THEN 'application/json; charset=utf-8'
                    ELSE 'application/json' END AS ctype,
    CASE event_type WHEN 'view' THEN '<html></html>' WHEN 'error' THEN 'not json'
                    ELSE '{{"ok": true, "id": ' || event_id || ', "props": ' || props || '}}' END AS body
  FROM events),
rb AS (SELECT *, method IN ('POST', 'PUT', 'PATCH') AND coalesce(post_data, '') <> '' AS has_body,
              lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)) AS host FROM rq),
api AS (SELECT * FROM rb WHERE rtype IN ('xhr', 'fetch') OR regexp_matches(url, {q(N.API_PATTERN)}) OR has_body)
"""

register("api_calls", _RQ + """
SELECT event_id::BIGINT AS event_id, method, url, rtype AS resource_type FROM api
""")(lambda spark, sf: N.api_calls(_logs(spark, sf)[0]).select(
    big("event_id").alias("event_id"), "method", "url", "resource_type"))


def _headers(spark, sf):
    r = N.normalize_requests(_logs(spark, sf)[0])
    return r.select(big("event_id").alias("event_id"), F.explode(F.map_keys("headers")).alias("header"))


register("request_headers", _RQ + """
SELECT event_id::BIGINT AS event_id, 'accept' AS header FROM rq
UNION ALL SELECT event_id::BIGINT, 'authorization' FROM rq WHERE event_id % 20 = 0
""")(_headers)


def _bodies(spark, sf):
    r = N.request_body(_logs(spark, sf)[0]).filter("has_body")
    kind = F.when(F.col("body_json").isNotNull(), F.lit("json")).otherwise(F.lit("text"))
    return r.select(big("event_id").alias("event_id"), kind.alias("kind"), "body_text")


register("request_body", _RQ + """
SELECT event_id::BIGINT AS event_id, CASE WHEN json_valid(post_data) THEN 'json' ELSE 'text' END AS kind,
       CASE WHEN json_valid(post_data) THEN NULL ELSE substring(post_data, 1, 500) END AS body_text
FROM rb WHERE has_body
""")(_bodies)

register("graphql", _RQ + """
SELECT event_id::BIGINT AS event_id, url, 'Signup' AS operation,
       'mutation Signup { create(id: ' || user_id || ') { id } }' AS query, user_id::BIGINT AS var_id
FROM rb WHERE t = 'signup'
""")(lambda spark, sf: N.graphql_operations(_logs(spark, sf)[0]).select(
    big("event_id").alias("event_id"), "url", "operation", "query",
    F.try_variant_get("variables", "$.id", "bigint").alias("var_id")))

register("json_responses", _RQ + """
SELECT event_id::BIGINT AS event_id, url, status FROM rq
WHERE contains(ctype, 'json') AND coalesce(body, '') <> '' AND json_valid(body)
""")(lambda spark, sf: N.json_responses(_logs(spark, sf)[1]).select(
    big("event_id").alias("event_id"), "url", "status"))

register("ws_messages", _RQ + """
SELECT 'wss://stream.example.com/feed' AS url, substring('tick ' || props, 1, 500) AS data FROM events
WHERE event_type = 'click' AND event_id % 3 = 0
""")(lambda spark, sf: N.ws_messages(_logs(spark, sf)[2]).select("url", "data"))

register("credential_exposure", _RQ + """
SELECT event_id::BIGINT AS event_id, host, 'authorization' AS header,
       sha256('Bearer dummy-' || event_id) AS value_sha256
FROM rb WHERE event_id % 20 = 0
""")(lambda spark, sf: N.credential_exposure(_logs(spark, sf)[0]).select(
    big("event_id").alias("event_id"), "host", "header", "value_sha256"))

register("cookie_inventory", _RQ + """
SELECT 'sid' AS name, host AS domain, length(user_id::VARCHAR)::BIGINT AS value_len,
       sha256(user_id::VARCHAR) AS value_sha256, count(*)::BIGINT AS n
FROM rb GROUP BY host, user_id
""")(lambda spark, sf: N.cookie_inventory(_logs(spark, sf)[0]).select(
    "name", "domain", big("value_len").alias("value_len"), "value_sha256", big("n").alias("n")))


def _stats(spark, sf):
    req, resp, ws = _logs(spark, sf)
    s = N.capture_stats(req, resp, ws)
    return s.select(*[big(c).alias(c) for c in
                      ("total_requests", "api_calls", "json_responses", "graphql_ops", "ws_messages")])


register("capture_stats", _RQ + """
SELECT (SELECT count(*) FROM rq)::BIGINT AS total_requests, (SELECT count(*) FROM api)::BIGINT AS api_calls,
       (SELECT count(*) FROM rq WHERE contains(ctype, 'json') AND json_valid(body))::BIGINT AS json_responses,
       (SELECT count(*) FROM rq WHERE t = 'signup')::BIGINT AS graphql_ops,
       (SELECT count(*) FROM rq WHERE t = 'click' AND event_id % 3 = 0)::BIGINT AS ws_messages
""")(_stats)

register("response_summary", _RQ + """
SELECT status::BIGINT AS status, ctype AS content_type, count(*)::BIGINT AS n FROM rq GROUP BY status, ctype
""")(lambda spark, sf: N.response_summary(_logs(spark, sf)[1]).select(
    big("status").alias("status"), "content_type", big("n").alias("n")))


def _hourly(spark, sf):
    w = N.windowed_stats(_logs(spark, sf)[0], "1 hour")
    return w.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                    big("total_requests").alias("total_requests"), big("api_calls").alias("api_calls"))


register("capture_stats_hourly", _RQ + """
SELECT strftime(date_trunc('hour', rb.ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*)::BIGINT AS total_requests,
       count(*) FILTER (WHERE rtype IN ('xhr', 'fetch') OR regexp_matches(url, '(?i)/api/|/graphql|/v\\d+/|\\.json|/rest/|/data/|/query|/search|/fetch|/ajax') OR has_body)::BIGINT AS api_calls
FROM rb GROUP BY 1
""")(_hourly)


def _counters(spark, sf):
    w = N.windowed_counters(*_logs(spark, sf), "1 hour")
    return w.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), *[big(c).alias(c) for c in N.COUNTERS])


register("capture_counters_hourly", _RQ + """, tagged AS (
  SELECT ts, 1 AS a, (rtype IN ('xhr', 'fetch') OR regexp_matches(url, '(?i)/api/|/graphql|/v\\d+/|\\.json|/rest/|/data/|/query|/search|/fetch|/ajax') OR has_body)::INT AS b,
         0 AS c, (t = 'signup')::INT AS d, 0 AS e FROM rb
  UNION ALL SELECT ts + to_seconds(event_id % 50), 0, 0, (contains(ctype, 'json') AND json_valid(body))::INT, 0, 0 FROM rq
  UNION ALL SELECT ts, 0, 0, 0, 0, 1 FROM rq WHERE t = 'click' AND event_id % 3 = 0)
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, sum(a)::BIGINT AS total_requests, sum(b)::BIGINT AS api_calls,
       sum(c)::BIGINT AS json_responses, sum(d)::BIGINT AS graphql_ops, sum(e)::BIGINT AS ws_messages
FROM tagged GROUP BY 1
""")(_counters)


register("unanswered_calls", _RQ + """
SELECT event_id::BIGINT AS event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, method, url FROM api WHERE event_id % 50 > 30
""")(lambda spark, sf: N.unanswered(*_logs(spark, sf)[:2]).select(
    big("event_id").alias("event_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "method", "url"))
