"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import licenses

_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
_ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op1_ngram_jaccard_join() -> str:
    words = _WORDS.format(text=_ASCII_LOWER)
    return f"""
WITH RECURSIVE words AS (SELECT doc_id, {words} AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
pairs AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach(u, v) AS (SELECT u, v FROM pairs UNION SELECT r.u, p.v FROM reach r JOIN pairs p ON r.v = p.u)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, least(s.doc_id, coalesce(min(r.v), s.doc_id))::BIGINT AS component_id
FROM sets s LEFT JOIN reach r ON r.u = s.doc_id GROUP BY s.doc_id, len(s.s)
"""


def op6_exact_dedup() -> str:
    return """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def op8_license_scan() -> str:
    words = r"regexp_extract_all({text}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    lower = _ASCII_LOWER
    places = []
    for phrase, _ in licenses.PHRASES:
        parts = phrase.split()
        same = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(parts, 1))
        places.append(f"list_filter(range(0, greatest(len(w) - {len(parts) - 1}, 0)), lambda i: {same})")
    values = ", ".join(f"('{label}', [{', '.join(repr(w) for w in sorted(set(notice.split())))}], {licenses.SPAN * len(notice.split())})" for label, notice in licenses.TEMPLATES)
    need = f"ceil(len(notice) * {licenses.THRESHOLD} - 1e-9)"
    names = [label for _, label in licenses.PHRASES]
    base = " || ".join(f"CASE WHEN len(p{k}) > 0 THEN ['{label}'] ELSE [] END" for k, label in enumerate(names))
    return f"""
WITH words AS (SELECT doc_id, {words.format(text=lower)} AS w, {lower} AS t FROM documents),
found AS (SELECT doc_id, w, t, {', '.join(f'{p} AS p{k}' for k, p in enumerate(places))} FROM words),
templates(label, notice, span) AS (VALUES {values}),
lines AS (SELECT DISTINCT doc_id, list_distinct({words.format(text='line')}) AS block FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM words)),
runs AS (
  SELECT doc_id, label, notice, unnest(list_filter(range(1, len(w) + 1), lambda i: list_contains(notice, w[i]))) AS i, w, span FROM words, templates
  WHERE contains(t, chr(10)) AND len(list_intersect(list_distinct(w), notice)) >= {need}),
blocks AS (
  SELECT doc_id, label, notice, len(list_intersect(block, notice)) AS common FROM lines, templates
  UNION ALL SELECT doc_id, label, notice, len(list_intersect(list_distinct(w[i:i + span - 1]), notice)) FROM runs),
shares AS (SELECT doc_id, label, common / len(notice) AS share FROM blocks WHERE common >= {need}),
best AS (SELECT doc_id, list(DISTINCT label) AS found_labels, max(share) AS share FROM shares GROUP BY doc_id),
all_of AS (SELECT f.*, p0 || p1 || p2 AS p, {base} AS b, b.found_labels, b.share FROM found f LEFT JOIN best b USING (doc_id))
SELECT doc_id, len(w)::BIGINT AS n_words, len(p)::BIGINT AS n_base, list_min(p)::BIGINT AS first_word, list_max(p)::BIGINT AS last_word,
  array_to_string(list_sort(b), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(b || coalesce(found_labels, []))), ',') AS labels,
  CASE WHEN len(b) > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score
FROM all_of
"""


def op9_substring_dedup() -> str:
    words = _WORDS.format(text="coalesce(text, '')")
    return f"""
WITH words AS (SELECT doc_id, {words} AS w FROM documents),
wins AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, w FROM words WHERE len(w) >= 20),
hashed AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS x FROM wins),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) AS k FROM hashed) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM later),
lists AS (SELECT doc_id, list(i) AS g FROM gone GROUP BY doc_id),
kept AS (SELECT w.doc_id, w.w, coalesce(l.g, []) AS g FROM words w LEFT JOIN lists l USING (doc_id))
SELECT doc_id, len(w)::BIGINT AS n_words, len(g)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(list_transform(list_sort(list_where(range(1, len(w) + 1), list_transform(range(1, len(w) + 1), lambda i: NOT list_contains(g, i)))), lambda i: w[i]), ' '), '')) AS kept_sha256
FROM kept
"""


def oracle_sql() -> dict[str, str]:
    return {f.__name__: f() for f in (op1_ngram_jaccard_join, op6_exact_dedup, op8_license_scan, op9_substring_dedup)}
