"""Column-level text helpers (all JVM-side, no Python UDFs).

Python's ``str.strip``/``split`` and ``re`` treat whitespace, digits and word
characters as Unicode; Java regex needs ``(?U)`` for the same behaviour.
"""

from __future__ import annotations

import json
import re
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Patterns and keyword lists that must equal the reference's behaviour.
# Price, e-mail, phone and opening-hours patterns.
PRICE_RE = r"(?iU)[\$€£¥₹]\s?\d+[\d,\.]*|\d+[\d,\.]*\s?(?:USD|EUR|MXN|COP|usd|eur)"
EMAIL_RE = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
PHONE_RE = r"(?U)(\+?\d[\d\s\-\.\(\)]{7,}\d)"
HOURS_RE = (r"(?iU)(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun|Monday|Tuesday|Wednesday|Thursday"
            r"|Friday|Saturday|Sunday)[\w\s,\-:]+\d{1,2}:\d{2}")
# Price keywords (the only keyword list the business extractor uses).
PRICE_KEYWORDS = ["price", "pricing", "plan", "cost", "fee", "rate", "subscription",
                  "per month", "per year", "annually"]
# Character references: named or numeric, closed by a semicolon.
REFERENCE_RE = r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);"
# ---------------------------------------------------------------------------

# Characters Python's str.isspace() accepts.
_SPACE_CHARS = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PYSPACE = rf"[{_SPACE_CHARS}]"
# The HTML table of named references, as the standard library lists it.
_NAMED = {k: v for k, v in html5.items() if k.endswith(";")}
_COMMON = ["amp;", "lt;", "gt;", "quot;", "apos;", "nbsp;", "copy;", "middot;"]   # looked up first


def pystrip(c: Column) -> Column:
    """``str.strip()``: remove leading/trailing Unicode whitespace."""
    return F.regexp_replace(c, rf"^{_PYSPACE}+|{_PYSPACE}+$", "")


def collapse_ws(c: Column) -> Column:
    """``re.sub(r'\\s+', ' ', s)`` with Unicode ``\\s``."""
    return F.regexp_replace(c, r"(?U)\s+", " ")


def word_count(c: Column) -> Column:
    """``len(s.split())``."""
    return F.size(F.regexp_extract_all(c, F.lit(rf"[^{_SPACE_CHARS}]+"), F.lit(0)))


def strip_join(parts: Column, sep: str = " ") -> Column:
    """``sep.join(t.strip() for t in parts if t.strip())``."""
    return F.array_join(F.filter(F.transform(parts, pystrip), lambda x: x != ""), sep)


def join_strip(parts: Column, sep: str = " ") -> Column:
    """``sep.join(parts).strip()``."""
    return pystrip(F.array_join(parts, sep))


def _code_point(ref: Column) -> Column:
    """Character of a numeric reference; U+FFFD where there is none."""
    digits = F.regexp_extract(ref, r"^&#[xX]?0*([0-9a-fA-F]*);$", 1)
    known = (F.length(digits) > 0) & (F.length(digits) <= 7)   # without leading zeros no more are in range
    n = F.when(~known, F.lit("0")).when(ref.rlike(r"^&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).cast("bigint")
    n = F.when((n <= 0) | (n > 0x10FFFF) | ((n >= 0xD800) & (n <= 0xDFFF)), F.lit(0xFFFD)).otherwise(n)
    return F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")


def _decoded(ref: Column) -> Column:
    """What one reference stands for; unknown names stay as they are."""
    def named(table: dict[str, str]) -> Column:
        return F.from_json(F.lit(json.dumps(table)), "map<string,string>")[F.substring(ref, 2, 64)]

    return (F.when(F.substring(ref, 2, 1) == "#", _code_point(ref))
            .otherwise(F.coalesce(named({k: _NAMED[k] for k in _COMMON}), named(_NAMED), ref)))


def unescape(c: Column) -> Column:
    """Decode HTML character references, each once."""
    parts = F.split(c, REFERENCE_RE, -1)
    refs = F.regexp_extract_all(c, F.lit(REFERENCE_RE), F.lit(0))
    decoded = F.concat(F.try_element_at(parts, F.lit(1)), F.array_join(F.zip_with(
        refs, F.slice(parts, 2, F.size(parts)), lambda e, p: F.concat(_decoded(e), p)), ""))
    return F.when(c.contains("&") & c.contains(";"), decoded).otherwise(c)


_PY_REFERENCE = re.compile(REFERENCE_RE)
_PY_DIGITS = re.compile(r"&#[xX]?0*([0-9a-fA-F]*);")


def _reference(m: re.Match) -> str:
    ref = m[0]
    if ref[1] != "#":
        return _NAMED.get(ref[1:65], ref)
    digits = _PY_DIGITS.fullmatch(ref)[1]
    n = int(digits, 16 if ref[2] in "xX" else 10) if 0 < len(digits) <= 7 else 0   # without leading zeros no more are in range
    return chr(n) if 0 < n <= 0x10FFFF and not 0xD800 <= n <= 0xDFFF else "\ufffd"


def unescaped(s: str) -> str:
    """``unescape`` of one text, for functions that read a page in one pass."""
    return _PY_REFERENCE.sub(_reference, s) if "&" in s and ";" in s else s


def emails(c: Column) -> Column:
    """Distinct e-mail matches, sorted (the reference returns a set)."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(EMAIL_RE), F.lit(0))))


def phones(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(PHONE_RE), F.lit(1))))


def opening_hours(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(HOURS_RE), F.lit(0))))


def prices(c: Column) -> Column:
    """All price matches in order (``PRICE_RE.findall``)."""
    return F.regexp_extract_all(c, F.lit(PRICE_RE), F.lit(0))


def has_keyword(c: Column, keywords: list[str]) -> Column:
    """Lower-cased substring test against any keyword."""
    return F.lower(c).rlike("|".join(rf"\Q{k}\E" for k in keywords))


def cut(c: Column, n: int) -> Column:
    """Python ``s[:n]``."""
    return F.substring(c, 1, n)


def preview(c: Column, n: int = 120) -> Column:
    """Cut at ``n`` characters and append ``...`` when longer."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)
