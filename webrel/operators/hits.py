"""Search hits, profiles and positions in nested payloads without a fixed schema.

Payloads are VARIANT values.  Their lists are unnested by lateral ``variant_explode``
(``pos`` keeps their order), so nothing is parsed against a schema that has to
name every shape; values that are no objects where an object is due give no row.
One narrow row per hit leaves the generator; no shuffle, and a payload is one row of
the input, so a task holds no more than one payload at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webrel.functions import text as TX

# --- fixed values -----------------------------------------------------------
# Where the described entity of a hit is kept, in order of preference (else the hit itself).
ENTITY_KEYS = ["entityResult", "member", "entityLockupView"]
# Where its name is kept, in order of preference.
NAME_PATHS = ["$.title.text", "$.firstName", "$.primaryText.text"]
# The name shown for people outside of one's network.
PLACEHOLDER_NAME = "linkedin member"
SITE = "https://www.linkedin.com"
# ---------------------------------------------------------------------------

_BLANK = ["", "{}", "[]", "0", "0.0", "false"]


def _at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _said(v: Column) -> Column:
    """The value, if it says anything: not missing, null, empty, zero or false."""
    return F.when(~F.try_variant_get(v, "$", "string").isin(_BLANK), v)


def _object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _first_text(v: Column, paths: list[str]) -> Column:
    """The first of the texts that is not empty, else ''."""
    return F.coalesce(*[F.nullif(F.try_variant_get(v, p, "string"), F.lit("")) for p in paths], F.lit(""))


def _unnest(rows: DataFrame, lists: Column, pos: str, value: str, outer: bool = False) -> DataFrame:
    """One row per element of a VARIANT list (``outer``: one with nulls where there is none)."""
    tvf = rows.sparkSession.tvf
    each = (tvf.variant_explode_outer if outer else tvf.variant_explode)(F.col("_list").outer())
    out = rows.withColumn("_list", lists).lateralJoin(each.select(
        F.col("pos").alias(pos), F.col("key").alias("_key"), F.col("value").alias(value)))
    return out.filter(F.col("_key").isNull()).drop("_key", "_list")   # members of objects have a key


def _elements(rows: DataFrame, payload: str, paths: list[str], pos: str, value: str) -> DataFrame:
    """Elements of the first of the lists at ``paths`` that has any."""
    lists = [F.when(F.size(F.try_variant_get(payload, p, "array<variant>")) > 0, _at(F.col(payload), p)) for p in paths]
    return _unnest(rows, F.coalesce(*lists), pos, value)


def nested_search_hits(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """People in nested search results, in the order of groups and hits.

    A payload lists groups (at ``data.elements``, else ``elements``); a group lists hits, or
    is a hit itself; the entity of a hit, its name, headline and url have fall-backs.
    Hits without a name or with the placeholder name are dropped, groups and hits that are
    no objects are skipped.  Other columns of ``rows`` are kept."""
    keep = [c for c in rows.columns if c != payload]
    g = _elements(rows, payload, ["$.data.elements", "$.elements"], "group_no", "_group")
    listed = F.coalesce(F.map_contains_key(_object(F.col("_group")), "elements"), F.lit(False))
    g = g.filter(_object(F.col("_group")).isNotNull()).withColumn("_listed", listed)
    h = _unnest(g, _at(F.col("_group"), "$.elements"), "hit_no", "_inner", outer=True)
    h = h.withColumn("hit_no", F.when(F.col("_listed"), F.col("hit_no")).otherwise(0))
    h = h.withColumn("_hit", F.when(F.col("_listed"), F.col("_inner")).otherwise(F.col("_group")))
    hit = F.col("_hit")
    h = h.filter(_object(hit).isNotNull())
    h = h.withColumn("_entity", F.coalesce(*[_said(_at(hit, f"$.{k}")) for k in ENTITY_KEYS], hit))
    e = F.col("_entity")
    h = h.filter(_object(e).isNotNull())
    name = _first_text(e, NAME_PATHS)
    url = _first_text(e, ["$.navigationUrl", "$.url"])
    tracking = F.coalesce(F.nullif(_first_text(hit, ["$.trackingUrn"]), F.lit("")), _first_text(e, ["$.trackingUrn"]))
    told = F.try_variant_get(e, "$.insightViewModel.insightComponents", "array<variant>")
    told = F.filter(F.transform(told, lambda c: F.try_variant_get(c, "$.lockupViewModel.title.text", "string")), lambda t: t != "")
    out = h.select(
        *keep, "group_no", "hit_no", F.regexp_extract(tracking, r":member:(\d+)", 1).alias("profile_id"), name.alias("_name"),
        _first_text(e, ["$.primarySubtitle.text", "$.subtitle.text"]).alias("headline"),
        _first_text(e, ["$.secondarySubtitle.text"]).alias("location"),
        F.when((url != "") & ~url.startswith("http"), F.concat(F.lit(SITE), url)).otherwise(url).alias("profile_url"),
        F.coalesce(F.try_element_at(told, F.lit(1)), F.lit("")).alias("snippet"), F.lit("nested_search").alias("source"))
    out = out.filter((F.col("_name") != "") & (F.lower("_name") != PLACEHOLDER_NAME))
    return out.withColumn("name", TX.pystrip(F.col("_name"))).drop("_name")


def profile_fields(payload: Column) -> Column:
    """MAP of the fields that a profile payload states (empty ones are left out)."""
    first, last = _first_text(payload, ["$.firstName"]), _first_text(payload, ["$.lastName"])
    fields = {
        "first_name": first, "last_name": last, "name": TX.pystrip(F.concat(first, F.lit(" "), last)),
        "headline": _first_text(payload, ["$.headline"]), "summary": _first_text(payload, ["$.summary"]),
        "location": _first_text(payload, ["$.locationName", "$.geoLocationName"]),
        "connections": _first_text(payload, ["$.connectionsCount"]),
        "country": _first_text(payload, ["$.geoCountryName", "$.geoRegionName"]),
        "industry": _first_text(payload, ["$.industryName"]),
    }
    every = F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v)])
    return F.map_filter(every, lambda k, v: v != "")


def position_rows(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """Positions of a payload (``elements``, else ``data.elements``), in order; a title is required,
    the description is cut at 300 characters.  Other columns of ``rows`` are kept."""
    keep = [c for c in rows.columns if c != payload]
    p = _elements(rows, payload, ["$.elements", "$.data.elements"], "position_no", "_position")
    p = p.withColumn("_entity", F.coalesce(_said(_at(F.col("_position"), "$.entityLockupView")), F.col("_position")))
    e = F.col("_entity")
    text = lambda k: _first_text(e, [f"$.{k}.text"])
    return p.select(*keep, "position_no", text("title").alias("title"), text("subtitle").alias("company"),
                    text("metadata").alias("date_range"), TX.cut(text("description"), 300).alias("description")).filter(F.col("title") != "")
