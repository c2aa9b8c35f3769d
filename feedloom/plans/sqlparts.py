"""Reusable DuckDB SQL fragments for the oracle twins (token table, list helpers)."""

from __future__ import annotations

from feedloom.functions.tree import CLOSED_BY, HELD_BY, INLINE_TAGS, VOID_TAGS
from feedloom.operators.tokens import TOKEN_RE


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def tokens_sql(src: str, key: str = "page_id", html: str = "html") -> str:
    """CTE body: tokens of ``src`` with tag, kind and same-tag level (twin of ``html_tokens``)."""
    void = ", ".join(q(t) for t in VOID_TAGS)
    return f"""
SELECT {key}, pos, tok, tag, kind,
       CAST(CASE WHEN kind = 'close' THEN dep + 1 ELSE dep END AS INTEGER) AS level
FROM (
  SELECT *, sum(CASE WHEN kind = 'open' THEN 1 WHEN kind = 'close' THEN -1 ELSE 0 END)
              OVER (PARTITION BY {key}, tag ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS dep
  FROM (
    SELECT {key}, pos, tok, tag,
      CASE WHEN NOT starts_with(tok, '<') THEN 'text'
           WHEN starts_with(tok, '<!--') THEN 'comment'
           WHEN starts_with(tok, '<!') OR starts_with(tok, '<?') THEN 'decl'
           WHEN tag = '' THEN 'text'
           WHEN starts_with(tok, '</') THEN 'close'
           WHEN tag IN ('script', 'style') THEN 'raw'
           WHEN tag IN ({void}) OR suffix(tok, '/>') THEN 'void'
           ELSE 'open' END AS kind
    FROM (
      SELECT {key}, CAST(pos - 1 AS INTEGER) AS pos, tok,
             lower(regexp_extract(tok, '^</?([A-Za-z][A-Za-z0-9]*)', 1)) AS tag
      FROM (SELECT {key}, unnest(t) AS tok, unnest(generate_series(1, len(t))) AS pos
            FROM (SELECT {key}, regexp_extract_all({html}, {q(TOKEN_RE)}) AS t FROM {src}) a) b) c) d) e
"""


def _any_of(x: str, tags) -> str:
    return f"{x} IN ({', '.join(q(t) for t in tags)})" if tags else "FALSE"


def ends_sql(tokens: str, key: str = "page_id") -> str:
    """CTE body: (key, pos, end_pos) of open tags; end_pos is null where the page ends first.

    A recursive walk over the tags of each page: ``st`` are the open elements,
    ``c`` the first of them that the next tag ends.
    """
    closes = "CASE st[i] " + " ".join(f"WHEN {q(x)} THEN {_any_of('tag', by)}" for x, by in CLOSED_BY.items()) + " ELSE FALSE END"
    held = ("CASE st[i] WHEN 'p' THEN NOT " + _any_of("y", INLINE_TAGS) + " "
            + " ".join(f"WHEN {q(x)} THEN {_any_of('y', by)}" for x, by in HELD_BY.items()) + " ELSE FALSE END")
    every = "generate_series(1, len(st))"
    free = f"len(list_filter(st[i + 1:], lambda y: {held})) = 0"
    implied = f"list_min(list_filter({every}, lambda i: {closes} AND {free}))"
    same = (f"list_max(list_filter({every}, lambda i: st[i] = tag AND (NOT {_any_of('tag', INLINE_TAGS)} "
            f"OR len(list_filter(st[i + 1:], lambda y: NOT {_any_of('y', INLINE_TAGS)})) = 0)))")
    return f"""
SELECT * FROM (
WITH RECURSIVE oc AS (SELECT {key}, pos, tag, kind, row_number() OVER (PARTITION BY {key} ORDER BY pos) AS n
                      FROM {tokens} WHERE kind IN ('open', 'close', 'void')),
walk AS (
  SELECT DISTINCT {key}, CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS st, CAST([] AS INTEGER[]) AS sp,
         CAST([] AS STRUCT(p INTEGER, e INTEGER)[]) AS done FROM oc
  UNION ALL
  SELECT {key}, n, CASE WHEN kind = 'open' THEN list_append(st[1:c - 1], tag) ELSE st[1:c - 1] END,
         CASE WHEN kind = 'open' THEN list_append(sp[1:c - 1], pos) ELSE sp[1:c - 1] END,
         list_transform(generate_series(c, len(st)), lambda i: {{'p': sp[i],
           'e': CAST(CASE WHEN kind = 'close' AND i = c THEN pos ELSE pos - 1 END AS INTEGER)}})
  FROM (SELECT oc.{key}, oc.n, oc.pos, oc.tag, oc.kind, walk.st, walk.sp,
               CAST(coalesce(CASE WHEN kind = 'close' THEN {same} ELSE {implied} END, len(st) + 1) AS BIGINT) AS c
        FROM walk JOIN oc ON oc.{key} = walk.{key} AND oc.n = walk.n + 1) step),
ended AS (SELECT {key}, unnest(done) AS d FROM walk)
SELECT oc.{key}, oc.pos, ended.d.e AS end_pos
FROM oc LEFT JOIN ended ON ended.{key} = oc.{key} AND ended.d.p = oc.pos WHERE oc.kind = 'open') ends_of_pages
"""


def covered_sql(tokens: str, intervals: str, key: str = "page_id") -> str:
    """CTE body: tokens with ``inside`` (twin of ``covered``); intervals = (key, start, stop)."""
    return f"""
SELECT {key}, pos, tok, tag, kind, level, cov > 0 AS inside FROM (
  SELECT *, sum(delta) OVER (PARTITION BY {key} ORDER BY pos, ord
                             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cov
  FROM (
    SELECT {key}, pos, tok, tag, kind, level, 1 AS ord, 0 AS delta FROM {tokens}
    UNION ALL SELECT {key}, start, NULL, NULL, NULL, NULL, 0, 1 FROM {intervals}
    UNION ALL SELECT {key}, stop, NULL, NULL, NULL, NULL, 2, -1 FROM {intervals}) u) v
WHERE ord = 1
"""


def reassemble_sql(tokens: str, key: str = "page_id", out: str = "html") -> str:
    return f"SELECT {key}, string_agg(tok, '' ORDER BY pos) AS {out} FROM {tokens} GROUP BY {key}"


def first_match_sql(pats: str, text: str, flags: str = "") -> str:
    pre = f"{q(flags)} || " if flags else ""
    return f"list_filter(coalesce({pats}, CAST([] AS VARCHAR[])), lambda p: regexp_matches({text}, {pre}p))[1]"


def excise_sql(pats: str, text: str, flags: str = "(?s)") -> str:
    pre = f"{q(flags)} || " if flags else ""
    return (f"list_reduce(coalesce({pats}, CAST([] AS VARCHAR[])), "
            f"lambda acc, p: regexp_replace(acc, {pre}p, '', 'g'), {text})")


def crop_sql(text: str, start_pats: str, end_pats: str) -> str:
    """Twin of ``functions.html.crop`` (nested scalar subexpressions)."""
    ps = first_match_sql(start_pats, text)
    c1 = (f"(CASE WHEN {ps} IS NULL THEN {text} ELSE "
          f"regexp_replace({text}, '\\A(?s:.*?)(?:' || {ps} || ')', '') END)")
    pe = first_match_sql(end_pats, c1)
    return (f"(CASE WHEN {pe} IS NULL THEN {c1} ELSE "
            f"regexp_replace({c1}, '(?:' || {pe} || ')(?s:.*)\\z', '') END)")
