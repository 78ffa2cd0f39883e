"""URL column expressions.

URLs are split with the RFC 3986 appendix-B pattern instead of
``parse_url`` (which returns NULL on spaces and drops ports, decision Q17).
Relative references are resolved like Python's ``urljoin``: dot segments are
removed with an ``aggregate`` over the path segments.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Link prefixes that are never followed.
SKIP_PREFIXES = ["mailto:", "tel:", "javascript:", "#"]
# Host substrings that select a fetch strategy (stealth wins over dynamic).
STEALTH_SIGNALS = ["linkedin", "cloudflare", "distil", "akamai", "incapsula",
                   "datadome", "perimeterx", "kasada"]
DYNAMIC_SIGNALS = ["twitter", "instagram", "facebook", "tiktok", "youtube",
                   "reddit", "airbnb", "zillow"]
# ---------------------------------------------------------------------------

URI_RE = r"^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?$"


def _part(c: Column, i: int) -> Column:
    return F.regexp_extract(c, URI_RE, i)


def scheme(c: Column) -> Column:
    return F.lower(_part(c, 2))


def netloc(c: Column) -> Column:
    """Authority as ``urlparse(..).netloc`` (port and ``www.`` kept)."""
    return _part(c, 4)


def host(c: Column) -> Column:
    return F.lower(F.regexp_replace(netloc(c), r"^.*@|:\d*$", ""))


def path(c: Column) -> Column:
    return _part(c, 5)


def has_query(c: Column) -> Column:
    return _part(c, 6) != ""


def query(c: Column) -> Column:
    return _part(c, 7)


def _remove_dots(p: Column) -> Column:
    """urljoin's segment walk: '..' pops, '.' is skipped; a trailing '.'/'..'
    leaves a trailing slash."""
    segs = F.split(p, "/", -1)
    walked = F.aggregate(
        segs, F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc).otherwise(F.concat(acc, F.array(s))))
    walked = F.when(F.try_element_at(segs, F.lit(-1)).isin(".", ".."), F.concat(walked, F.array(F.lit("")))).otherwise(walked)
    out = F.array_join(walked, "/")
    return F.when(out == "", F.lit("/")).otherwise(out)


def urljoin(base: Column, href: Column) -> Column:
    """Python ``urljoin(base, href)`` for http(s)-style URLs."""
    href = F.regexp_replace(F.regexp_replace(href, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\r\n]", "")
    b_scheme, b_net, b_path = _part(base, 2), _part(base, 4), _part(base, 5)
    b_q = _part(base, 6)
    h_scheme, h_auth, h_net, h_path = _part(href, 2), _part(href, 3), _part(href, 4), _part(href, 5)
    h_q, h_frag = _part(href, 6), _part(href, 8)
    prefix = F.concat(F.when(b_scheme != "", F.concat(b_scheme, F.lit(":"))).otherwise(F.lit("")),
                      F.when(b_net != "", F.concat(F.lit("//"), b_net)).otherwise(F.lit("")))
    # relative path merge: base directory + href path, inner empty segments dropped
    base_dir = F.when(b_path == "", F.lit("/")).otherwise(F.regexp_replace(b_path, r"[^/]*$", ""))
    merged = F.concat(base_dir, h_path)
    merged_segs = F.split(merged, "/", -1)
    n = F.size(merged_segs)
    inner = F.filter(F.slice(merged_segs, 2, F.greatest(n - 2, F.lit(0))), lambda s: s != "")
    merged_clean = F.when(n <= 2, merged).otherwise(
        F.array_join(F.concat(F.slice(merged_segs, 1, 1), inner, F.slice(merged_segs, -1, 1)), "/"))
    rel_path = F.when(h_path.startswith("/"), _remove_dots(h_path)).otherwise(_remove_dots(merged_clean))
    rel_path = F.when(rel_path.startswith("/") | (b_net == ""), rel_path).otherwise(F.concat(F.lit("/"), rel_path))
    h_q = F.when(_part(href, 7) != "", h_q).otherwise(F.lit(""))
    h_frag = F.when(_part(href, 9) != "", h_frag).otherwise(F.lit(""))
    path_only = F.concat(prefix, rel_path, h_q, h_frag)
    b_q = F.when(_part(base, 7) != "", b_q).otherwise(F.lit(""))
    empty_path = F.concat(prefix, b_path, F.when(h_q != "", h_q).otherwise(b_q), h_frag)
    return (F.when(h_scheme != "", F.concat(F.lower(h_scheme), F.lit(":"), F.regexp_replace(href, r"^[^:]*:", "")))
            .when(h_auth != "", F.concat(F.when(b_scheme != "", F.concat(b_scheme, F.lit(":"))).otherwise(F.lit("")),
                                         href))
            .when(h_path == "", empty_path)
            .otherwise(path_only))


def drop_fragment(u: Column) -> Column:
    return F.regexp_replace(u, r"#.*$", "")


def normalize_link(base: Column, href: Column) -> Column:
    """NULL for empty / mailto: / tel: / javascript: / '#' hrefs (case
    sensitive prefixes), else the absolute URL without fragment."""
    skip = F.coalesce(href, F.lit("")) == ""
    for p in SKIP_PREFIXES:
        skip = skip | href.startswith(p)
    return F.when(~skip, drop_fragment(urljoin(base, href)))


def same_site(base: Column, url: Column) -> Column:
    """Equal netloc, or the URL has none."""
    return (netloc(url) == "") | (netloc(url) == netloc(base))


def fetch_class(url: Column) -> Column:
    """Classify a site by host signals -> stealth | dynamic | http."""
    h = F.lower(netloc(url))
    stealth = F.lit(False)
    for s in STEALTH_SIGNALS:
        stealth = stealth | h.contains(s)
    dynamic = F.lit(False)
    for s in DYNAMIC_SIGNALS:
        dynamic = dynamic | h.contains(s)
    return F.when(stealth, "stealth").when(dynamic, "dynamic").otherwise("http")


def snapshot_slug(url: Column) -> Column:
    """Host (``www.`` removed, dots -> _) + '__' + path ('home' if empty)."""
    h = F.replace(F.replace(netloc(url), F.lit("www."), F.lit("")), F.lit("."), F.lit("_"))
    p = F.replace(F.regexp_replace(path(url), r"^/+|/+$", ""), F.lit("/"), F.lit("_"))
    return F.concat(h, F.lit("__"), F.when(p == "", F.lit("home")).otherwise(p))


def export_host(url: Column) -> Column:
    """S10 host part: ``www.`` removed, dots -> _."""
    return F.replace(F.replace(netloc(url), F.lit("www."), F.lit("")), F.lit("."), F.lit("_"))


def clean_url(url: Column) -> Column:
    """Drop query and trailing slash."""
    return F.regexp_replace(F.regexp_replace(url, r"\?.*$", ""), r"/$", "")


def profile_url(slug: Column, base: str) -> Column:
    """Values not starting with ``http`` get the entity base URL."""
    return F.when(slug.startswith("http"), slug).otherwise(F.concat(F.lit(base), slug))
