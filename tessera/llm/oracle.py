"""SQL (DuckDB's) for the queries that SQL can express."""

from __future__ import annotations

from tessera.llm import mixing, near_dedup, url_filter
from tessera.llm._common import ASCII_LOWER, ASCII_UPPER, WORD


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _lower(x: str) -> str:
    return f"translate({x}, '{ASCII_UPPER}', '{ASCII_LOWER}')"


def _pattern_sql(text: str) -> str:
    """A pattern without * as plain string tests over rest (what follows ://, lower-cased) and host."""
    if text.startswith("||"):  # all of it is of the host, at the start of a label
        return f"contains('.' || host, {_text('.' + text[2:])})"
    if "^" in text:  # separators become spaces, and one stands at the end
        return f"contains(regexp_replace(rest, '[^a-z0-9_.%-]', ' ', 'g') || ' ', {_text(text.replace('^', ' '))})"
    return f"contains(rest, {_text(text)})"


def url_filter_sql() -> str:
    parts = r"'(?s)^.*?://([^/?#]*)([^?#]*)'"
    rules = ", ".join(f"({_text(v)}, {_text(t)}, {_text(t.split('/')[0])}, {_text('/' + t.split('/', 1)[1])})" for v, t in url_filter.HOST_RULES)
    hit = lambda verdict: " OR ".join(_pattern_sql(t) for v, t in url_filter.PATTERN_RULES if v == verdict) or "false"
    return f"""WITH u AS (SELECT page_id, COALESCE({_lower(f"regexp_extract(url, {parts}, 1)")}, '') AS host, COALESCE(regexp_extract(url, {parts}, 2), '') AS path,
COALESCE({_lower("regexp_extract(url, '(?s)^.*?://(.*)$', 1)")}, '') AS rest FROM pages), r(verdict, rule, h, p) AS (VALUES {rules})
SELECT page_id, host, path, best.rule AS rule, COALESCE(best.verdict, CASE WHEN {hit('allow')} THEN 'allow' WHEN {hit('block')} THEN 'block' ELSE 'allow' END) AS verdict
FROM (SELECT *, (SELECT arg_max({{'rule': rule, 'verdict': verdict}}, length(rule)) FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS best FROM u)"""


def mixing_sql(share: float = 1.5, most: float = 2.0, seed: int = 8) -> str:
    weights, n = list(map(float, mixing.WEIGHTS)), len(mixing.WEIGHTS)
    return f"""WITH RECURSIVE d AS (SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '{WORD}')), 0) AS size, (CAST('0x' || md5('{seed}|' || doc_id)[1:12] AS BIGINT) + 0.5) / {float(16**12)} AS u FROM documents),
s AS (SELECT source, CAST(SUM(size) AS BIGINT) AS source_size, CAST({weights}[1 + (ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1) % {n}] AS DOUBLE) AS w FROM d GROUP BY source),
l AS (SELECT *, {most} * source_size AS cap, GREATEST(0.0, (SUM(source_size) OVER ()) * {share} - COALESCE(SUM({most} * source_size) OVER (ORDER BY {most} * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / SUM(w) OVER (ORDER BY {most} * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s),
t AS (SELECT source, source_size, LEAST(cap, (MAX(CASE WHEN level * w <= cap THEN level END) OVER ()) * w) AS target FROM l),
a AS (SELECT *, CASE WHEN source_size > 0 THEN FLOOR(target / source_size) ELSE 0 END AS whole FROM t),
r AS (SELECT d.*, source_size, target, whole, CASE WHEN source_size > 0 THEN target / source_size - whole ELSE 0 END AS part, target - whole * source_size AS rest FROM d JOIN a ON d.source IS NOT DISTINCT FROM a.source),
o AS (SELECT *, ROW_NUMBER() OVER k AS n, SUM(size) OVER (k ROWS UNBOUNDED PRECEDING) <= rest AS fits FROM (SELECT *, (u / (1 - u)) / (part / (1 - part)) AS odds FROM r WHERE part > 0) WINDOW k AS (PARTITION BY source ORDER BY odds, doc_id, size)),
g AS (SELECT source, COUNT(*) FILTER (WHERE fits) AS n, ANY_VALUE(rest) - COALESCE(SUM(size) FILTER (WHERE fits), 0) AS gap FROM o GROUP BY source),
f AS (SELECT source, n, n AS fit, gap, false AS take FROM g UNION ALL SELECT f.source, o.n, fit, CASE WHEN o.size <= gap THEN gap - o.size ELSE gap END, o.size <= gap FROM f JOIN o ON o.source IS NOT DISTINCT FROM f.source AND o.n = f.n + 1 WHERE o.n <= fit + {mixing.TAIL}),
x AS (SELECT o.doc_id, o.fits OR COALESCE(f.take, false) AS extra FROM o LEFT JOIN f ON o.source IS NOT DISTINCT FROM f.source AND o.n = f.n AND NOT o.fits)
SELECT r.doc_id, r.size, r.source_size, r.target, CAST((r.whole + CASE WHEN COALESCE(x.extra, false) THEN 1 ELSE 0 END) * r.size AS BIGINT) AS taken FROM r LEFT JOIN x USING (doc_id)"""


def near_dedup_sql(percent: int = round(100 * near_dedup.SIMILARITY)) -> str:
    return f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(COALESCE({_lower('text')}, ''), '{WORD}') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * LEAST(a.n, b.n) >= {percent} * GREATEST(a.n, b.n) GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * COUNT(*) >= {percent} * (a.n + b.n - COUNT(*))),
l AS (SELECT a, b FROM p UNION SELECT b, a FROM p), c AS (SELECT doc_id AS i, doc_id AS j FROM s UNION SELECT c.i, l.b FROM c JOIN l ON c.j = l.a)
SELECT s.doc_id, len(s.s) AS n_shingles, m.component_id, s.doc_id = m.component_id AS kept FROM s JOIN (SELECT i, MIN(j) AS component_id FROM c GROUP BY i) m ON s.doc_id = m.i"""


ORACLE_SQL = {"op2_url_filter": url_filter_sql(), "op8_mixing": mixing_sql(), "op9_near_dedup": near_dedup_sql()}
