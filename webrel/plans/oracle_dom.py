"""DuckDB SQL building blocks for the correctness oracles of DOM queries.

The oracle re-states the element rules in plain SQL: forward-looking ``min``
frames for implied ends and range joins for containment (the Spark side uses
backward ``last`` windows and text-index slices instead), so the two agree only
when the semantics agree.  Test support only; never on the Spark path.
"""

from __future__ import annotations

import re

from webrel.operators.dom import AUTO_CLOSE, TOKEN_RE, VOID_TAGS

RE2_TOKEN = TOKEN_RE.replace("*+", "*").replace("++", "+")


# Named references that occur in the driver's tables and the rendered pages.
REFERENCES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0", "copy": "©", "middot": "·"}


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def in_list(xs) -> str:
    return "(" + ", ".join(q(x) for x in xs) + ")"


def unescape_sql(expr: str) -> str:
    out = expr
    for k, v in REFERENCES.items():
        out = f"replace({out}, {q('&' + k + ';')}, {q(v)})"
    return f"replace({out}, '&amp;', '&')"


def strip_sql(expr: str) -> str:
    return f"regexp_replace({expr}, '^\\s+|\\s+$', '', 'g')"


def attr_sql(tok: str, name: str) -> str:
    """Value of attribute ``name`` in start tag ``tok`` (NULL when absent)."""
    n = re.escape(name)
    pat = f"(?i)\\s{n}\\s*=\\s*(?:\"([^\"]*)\"|'([^']*)'|([^\\s\"'>]+))"
    has = f"(?i)\\s{n}(?:\\s*=|\\s|/?>)"
    val = " || ".join(f"regexp_extract({tok}, {q(pat)}, {g})" for g in (1, 2, 3))
    return f"CASE WHEN regexp_matches({tok}, {q(has)}) THEN {unescape_sql('(' + val + ')')} END"


def dom_ctes(pages: str = "pages") -> str:
    """CTEs ``tok``, ``el`` (elements), ``tx`` (texts with parent)."""
    raw_split = r"(?is)^(<[^>]*>)(.*)(</[a-z]+\s*>)$"
    trig_cols = []
    trig_case = []
    for name, (tags, closers) in AUTO_CLOSE.items():
        trig_cols.append(
            f"min(CASE WHEN kind IN ('open','void') AND tag IN {in_list(closers)} THEN pos END) "
            f"OVER (PARTITION BY page_id, dep0 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS tr_{name}")
        trig_case.append(f"WHEN tag IN {in_list(tags)} THEN tr_{name}")
    return f"""
t0 AS (SELECT page_id, regexp_extract_all(coalesce(html, ''), {q(RE2_TOKEN)}) AS toks FROM {pages}),
t1 AS (SELECT page_id, unnest(toks) AS tok, generate_subscripts(toks, 1) AS i FROM t0),
t2 AS (SELECT page_id, i,
         CASE WHEN regexp_matches(tok, {q(r'(?is)^<(script|style|textarea)\b')})
                   AND regexp_matches(tok, {q(r'(?is)</[a-z]+\s*>$')})
              THEN [{{'t': regexp_extract(tok, {q(raw_split)}, 1), 'k': NULL}},
                    {{'t': regexp_extract(tok, {q(raw_split)}, 2), 'k': 'raw'}},
                    {{'t': regexp_extract(tok, {q(raw_split)}, 3), 'k': NULL}}]
              ELSE [{{'t': tok, 'k': NULL}}] END AS parts FROM t1),
t3 AS (SELECT page_id, i, unnest(parts) AS s, generate_subscripts(parts, 1) AS j FROM t2),
t4 AS (SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY i, j) - 1)::BIGINT AS pos,
              s.t AS tok, s.k AS k0 FROM t3),
t5 AS (SELECT page_id, pos, tok,
         CASE WHEN k0 IS NOT NULL THEN k0
              WHEN starts_with(tok, '<!--') THEN 'comment'
              WHEN starts_with(tok, '<!') THEN 'doctype'
              WHEN regexp_matches(tok, '^</[a-zA-Z]') THEN 'close'
              WHEN regexp_matches(tok, '^<[a-zA-Z]') THEN
                   CASE WHEN lower(regexp_extract(tok, '^</?([a-zA-Z][^\\s/>]*)', 1)) IN {in_list(VOID_TAGS)}
                        THEN 'void' ELSE 'open' END
              ELSE 'text' END AS kind,
         lower(regexp_extract(tok, '^</?([a-zA-Z][^\\s/>]*)', 1)) AS tg FROM t4),
tok AS (SELECT page_id, pos, tok, kind, CASE WHEN kind IN ('open','close','void') THEN tg END AS tag,
          CASE WHEN kind = 'text' THEN {unescape_sql('tok')} WHEN kind = 'raw' THEN tok END AS text FROM t5),
m1 AS (SELECT *, sum(CASE WHEN kind='open' THEN 1 WHEN kind='close' THEN -1 ELSE 0 END)
          OVER (PARTITION BY page_id, tag ORDER BY pos ROWS UNBOUNDED PRECEDING) AS d FROM tok),
m2 AS (SELECT *, CASE WHEN kind='open' THEN d ELSE d + 1 END AS lvl FROM m1),
m3 AS (SELECT *, lead(kind) OVER w AS nk, lead(pos) OVER w AS np, lag(kind) OVER w AS pk
       FROM m2 WINDOW w AS (PARTITION BY page_id, tag, lvl ORDER BY pos)),
m4 AS (SELECT *, CASE WHEN kind='open' AND nk='close' THEN 1 WHEN kind='close' AND pk='open' THEN -1 ELSE 0 END AS delta
       FROM m3),
m5 AS (SELECT *, sum(delta) OVER (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING) - delta AS dep0 FROM m4),
m6 AS (SELECT *,
         min(CASE WHEN delta = -1 THEN pos END)
           OVER (PARTITION BY page_id, dep0 ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS cont,
         {', '.join(trig_cols)},
         max(pos) OVER (PARTITION BY page_id) + 1 AS page_end
       FROM m5),
el AS (SELECT page_id, pos AS start,
         CASE WHEN kind = 'void' THEN pos WHEN kind='open' AND nk='close' THEN np
              ELSE least(CASE {' '.join(trig_case)} END, cont, page_end) END AS "end",
         tag, tok, kind = 'void' AS void
       FROM m6 WHERE kind IN ('open','void')),
tx0 AS (SELECT page_id, pos, text, kind FROM tok WHERE text IS NOT NULL),
tx AS (SELECT t.page_id, t.pos, t.text, t.kind, max(e.start) AS parent_start
       FROM tx0 t LEFT JOIN el e ON e.page_id = t.page_id AND e.start < t.pos AND t.pos < e."end" AND NOT e.void
       GROUP BY t.page_id, t.pos, t.text, t.kind)
"""


def deep_text_sql(sel: str, sep: str = " ", mode: str = "join_strip") -> str:
    """SELECT page_id, start, text for elements in CTE ``sel`` (needs columns
    page_id, start, "end").  mode: join_strip | strip_join | first."""
    if mode == "first":
        agg = "arg_min(t.text, t.pos)"
        body = f"coalesce({agg}, '')"
    elif mode == "join_strip":
        body = strip_sql(f"coalesce(string_agg(t.text, {q(sep)} ORDER BY t.pos), '')")
    else:
        body = (f"coalesce(string_agg(CASE WHEN {strip_sql('t.text')} <> '' THEN {strip_sql('t.text')} END, "
                f"{q(sep)} ORDER BY t.pos), '')")
    return (f"SELECT s.page_id, s.start, {body} AS text FROM {sel} s "
            f"LEFT JOIN tx t ON t.page_id = s.page_id AND s.start < t.pos AND t.pos < s.\"end\" "
            f"GROUP BY s.page_id, s.start")
