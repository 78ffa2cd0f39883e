"""Captured-request analytics.

Live interception is not built; the same classification runs over request /
response / websocket logs.  Credential headers are reported as header name,
host and a SHA-256 of the value - never the value itself (decision N07).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webrel.functions import urls as U

# --- fixed values -----------------------------------------------------------
API_PATTERN = r"(?i)/api/|/graphql|/v\d+/|\.json|/rest/|/data/|/query|/search|/fetch|/ajax"
AUTH_HEADERS = ["authorization", "x-api-key", "x-auth-token", "bearer", "token"]
DROPPED_HEADERS = ["cookie", "user-agent"]
BODY_METHODS = ["POST", "PUT", "PATCH"]
# ---------------------------------------------------------------------------


def normalize_requests(req: DataFrame) -> DataFrame:
    """Headers without cookie and user-agent."""
    return req.withColumn("headers", F.map_filter("headers", lambda k, v: ~F.lower(k).isin(DROPPED_HEADERS)))


def request_body(req: DataFrame) -> DataFrame:
    """For POST/PUT/PATCH with a body: ``body_json`` (VARIANT) when it
    parses, else ``body_text`` = first 500 characters."""
    has = F.col("method").isin(BODY_METHODS) & (F.coalesce(F.col("post_data"), F.lit("")) != "")
    j = F.try_parse_json("post_data")
    return (req.withColumn("body_json", F.when(has, j))
            .withColumn("body_text", F.when(has & j.isNull(), F.substring("post_data", 1, 500)))
            .withColumn("has_body", has))


def api_calls(req: DataFrame, all_requests: bool = False) -> DataFrame:
    """xhr/fetch, or an API-looking URL, or a request body."""
    r = request_body(req) if "has_body" not in req.columns else req
    if all_requests:
        return r
    return r.filter(F.col("resource_type").isin("xhr", "fetch") | F.col("url").rlike(API_PATTERN) | F.col("has_body"))


def json_responses(resp: DataFrame) -> DataFrame:
    """Content type mentions json and the body parses."""
    p = F.try_parse_json("body")
    return resp.filter(F.col("content_type").contains("json") & (F.coalesce("body", F.lit("")) != "")) \
        .withColumn("data", p).filter(F.col("data").isNotNull())


def _is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def graphql_operations(req: DataFrame, include_batches: bool = False) -> DataFrame:
    """Bodies that are JSON objects with ``query`` or ``mutation``;
    ``include_batches`` also explodes top-level arrays of such objects (Q18)."""
    r = request_body(req) if "has_body" not in req.columns else req
    ops = r.filter(F.col("body_json").isNotNull()).select("event_id", "url", F.col("body_json").alias("op"))
    if include_batches:
        arr = F.try_variant_get("op", "$", "array<variant>")
        ops = ops.select("event_id", "url", F.explode(F.coalesce(arr, F.array("op"))).alias("op"))
    keys = F.map_keys(F.try_variant_get("op", "$", "map<string,variant>"))
    ops = ops.filter(_is_object(F.col("op")) & (F.array_contains(keys, "query") | F.array_contains(keys, "mutation")))
    return ops.select("event_id", "url",
                      F.coalesce(F.try_variant_get("op", "$.operationName", "string"), F.lit("")).alias("operation"),
                      F.substring(F.coalesce(F.try_variant_get("op", "$.query", "string"), F.lit("")), 1, 500)
                      .alias("query"),
                      F.try_variant_get("op", "$.variables", "variant").alias("variables"))


def ws_messages(ws: DataFrame) -> DataFrame:
    """Url and first 500 characters."""
    return ws.select("url", "ts", F.substring("data", 1, 500).alias("data"))


def credential_exposure(req: DataFrame) -> DataFrame:
    """N07 (re-aimed): which requests carry auth headers -> header name, host,
    SHA-256 of the value; the value is never output."""
    auth = req.select("event_id", "url", F.explode(F.map_filter("headers", lambda k, v: F.lower(k).isin(AUTH_HEADERS)))
                      .alias("header", "v"))
    return auth.select("event_id", U.host(F.col("url")).alias("host"), F.lower("header").alias("header"),
                       F.sha2(F.col("v"), 256).alias("value_sha256"))


def cookie_inventory(req: DataFrame) -> DataFrame:
    """Cookies seen in request headers: name, domain, value length and
    hash (the value itself is not kept)."""
    sent = F.map_values(F.map_filter("headers", lambda k, v: (F.lower(k) == "cookie") & v.isNotNull()))
    c = req.select(U.host(F.col("url")).alias("domain"), F.explode(sent).alias("sent"))
    c = c.select("domain", F.explode(F.split("sent", r";\s*")).alias("kv"))
    c = c.filter(F.col("kv").contains("="))
    c = c.select(F.regexp_extract("kv", r"^([^=]*)=", 1).alias("name"), "domain",
                 F.regexp_extract("kv", r"^[^=]*=(.*)$", 1).alias("value"))
    return c.groupBy("name", "domain", "value").count().select(
        "name", "domain", F.length("value").alias("value_len"), F.sha2("value", 256).alias("value_sha256"),
        F.col("count").alias("n"))


def _is_graphql() -> Column:
    keys = F.map_keys(F.try_variant_get("body_json", "$", "map<string,variant>"))
    return F.coalesce(F.col("body_json").isNotNull() & _is_object(F.col("body_json"))
                      & (F.array_contains(keys, "query") | F.array_contains(keys, "mutation")), F.lit(False))


def _is_api() -> Column:
    return F.col("resource_type").isin("xhr", "fetch") | F.col("url").rlike(API_PATTERN) | F.col("has_body")


def capture_stats(req: DataFrame, resp: DataFrame, ws: DataFrame) -> DataFrame:
    """The five counters in one row."""
    r = request_body(req)
    a = r.agg(F.count("*").alias("total_requests"), F.count_if(_is_api()).alias("api_calls"),
              F.count_if(_is_graphql()).alias("graphql_ops"))
    j = json_responses(resp).agg(F.count("*").alias("json_responses"))
    w = ws.agg(F.count("*").alias("ws_messages"))
    one = F.lit(1)
    return (a.withColumn("_k", one).join(j.withColumn("_k", one), "_k").join(w.withColumn("_k", one), "_k")
            .drop("_k"))


def response_summary(resp: DataFrame) -> DataFrame:
    """Responses grouped by status and content type."""
    return resp.groupBy("status", "content_type").agg(F.count("*").alias("n"))


def capture_report(req: DataFrame, resp: DataFrame) -> dict[str, DataFrame]:
    """First 30 API calls (url <= 100), GraphQL previews (<= 150), first 5
    credential rows (hashed)."""
    calls = api_calls(req).orderBy("ts", "event_id").limit(30).select(
        "method", F.substring("url", 1, 100).alias("url"), "resource_type")
    gql = graphql_operations(req).select("operation", F.substring("query", 1, 150).alias("preview"))
    auth = credential_exposure(req).orderBy("event_id").limit(5)
    return {"api_calls": calls, "graphql": gql, "auth": auth}


def windowed_stats(req: DataFrame, window: str = "1 hour", watermark: str | None = None) -> DataFrame:
    """N12 (window and watermark are our addition): request counters per event
    time window; works on a batch or a streaming ``req``."""
    r = req.withWatermark("ts", watermark) if watermark else req
    return request_body(r).groupBy(F.window("ts", window).alias("w")).agg(
        F.count("*").alias("total_requests"), F.sum(_is_api().cast("long")).alias("api_calls")) \
        .select(F.col("w.start").alias("window_start"), "total_requests", "api_calls")


COUNTERS = ["total_requests", "api_calls", "json_responses", "graphql_ops", "ws_messages"]


def windowed_counters(req: DataFrame, resp: DataFrame, ws: DataFrame, window: str = "1 hour",
                      watermark: str | None = None) -> DataFrame:
    """The five counters of N09 per event-time window, on batches or on three live
    feeds.

    Every feed keeps a watermark of its own; its rows become (time, which counters they
    add to) and the union of the three is aggregated once, so one row of state per open
    window is all that is kept.  Windows close at the slowest feed's watermark: a feed
    that is behind is waited for, rows behind the watermark are left out.  Rows without a
    time are in no window."""
    def tagged(rows: DataFrame, **adds: Column) -> DataFrame:
        rows = rows.withWatermark("ts", watermark) if watermark else rows
        return rows.select("ts", *[F.coalesce(adds.get(c, F.lit(False)), F.lit(False)).cast("int").alias(c) for c in COUNTERS])

    yes = F.lit(True)
    body = F.try_parse_json("body")
    is_json = F.col("content_type").contains("json") & (F.coalesce("body", F.lit("")) != "") & body.isNotNull()
    rows = tagged(request_body(req), total_requests=yes, api_calls=_is_api(), graphql_ops=_is_graphql()) \
        .unionByName(tagged(resp, json_responses=is_json)).unionByName(tagged(ws, ws_messages=yes))
    return rows.groupBy(F.window("ts", window).alias("w")).agg(*[F.sum(c).alias(c) for c in COUNTERS]) \
        .select(F.col("w.start").alias("window_start"), *COUNTERS)


def unanswered(req: DataFrame, resp: DataFrame, within: str = "30 seconds", watermark: str | None = None) -> DataFrame:
    """API calls without a response in the time ``within`` after them (an interval join of both
    logs by ``event_id``; on live feeds a call is reported once the watermarks have passed its time)."""
    calls = api_calls(req.withWatermark("ts", watermark) if watermark else req)
    told = resp.select(F.col("event_id").alias("_id"), F.col("ts").alias("_at"))
    told = told.withWatermark("_at", watermark) if watermark else told
    in_time = (F.col("event_id") == F.col("_id")) & (F.col("_at") >= F.col("ts")) & (F.col("_at") <= F.col("ts") + F.expr(f"interval {within}"))
    return calls.join(told, in_time, "left_outer").filter(F.col("_id").isNull()).select("event_id", "ts", "method", "url")
