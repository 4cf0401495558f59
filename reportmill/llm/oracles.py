"""SQL of the corpus queries that SQL can express, on the same tables."""

from __future__ import annotations

from .divergence import MIN_DOCS, SCALE, TOP_TERMS
from .negatives import LEAST, MOST, NEGATIVES, POSITIVES, SCALE as VECTOR_SCALE
from .quality_rules import BOILERPLATE, BOILERPLATE_WORDS, MENU_MARKS, SYMBOLS
from .url_filter import RULES, SPAM_HOST

_WORD = r"[^\x20\x09-\x0D]+"
_COUNT = "(length(line) - length(translate(line, '{0}', '')))"

QUALITY_RULES = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{_WORD}') AS ws FROM d),
grams AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (VALUES (0), (1), (2)) v(k) GROUP BY 1),
split AS (SELECT doc_id, string_split(t, chr(10)) AS ls FROM d),
lines AS (
  SELECT doc_id, num, line, len(regexp_extract_all(line, '{_WORD}')) AS n
  FROM (SELECT doc_id, generate_subscripts(ls, 1) AS num, unnest(ls) AS line FROM split) WHERE regexp_matches(line, '{_WORD}')
), judged AS (
  SELECT *, NOT regexp_matches(trim(regexp_replace(line, '[\x09-\x0D]', ' ', 'g')), '[.!?:;…]["''”’)\]»]*($|\s)')
    OR (length(line) - length(replace(replace(line, '!!', ''), '??', ''))) / 2 > 0.3 * n
    OR {_COUNT.format(SYMBOLS)} > 0.5 * n
    OR ({_COUNT.format(MENU_MARKS)} >= 3 AND {_COUNT.format(MENU_MARKS)} > 0.2 * n)
    OR (n <= {BOILERPLATE_WORDS} AND regexp_matches(lower(line), '{"|".join(BOILERPLATE)}')) AS fails
  FROM lines
), kept AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines, sum(n) FILTER (WHERE NOT fails) AS kept_words,
    string_agg(line, chr(10) ORDER BY num) FILTER (WHERE NOT fails) AS cleaned FROM judged GROUP BY 1
), counted AS (
  SELECT w.doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(t) - length(translate(t, '{SYMBOLS}', '')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
    coalesce(kept_words, 0)::BIGINT AS kept_words, sha256(coalesce(cleaned, '')) AS cleaned_sha256
  FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN kept USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * kept_words >= 50 * n_words AS kept, kept_words, cleaned_sha256
FROM counted
"""


def _rule_cases() -> str:
    by_length = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = "(host = '{1}' OR host LIKE '%.{1}') AND starts_with(path, '{2}')"
    return " ".join(f"WHEN {fits.format(*r)} THEN '{r[1]}{r[2]}:{r[0]}'" for r in by_length)


URL_FILTER = rf"""
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_replace(rest, '[/?#].*$', '', 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_replace(regexp_replace(rest, '[?#].*$', '', 's'), '^[^/]*', '') AS path FROM cut
), named AS (
  SELECT *, regexp_replace(host, '^(www|m)\.', '') || regexp_replace(regexp_replace(path, '/+$', ''), '\.html?$', '') AS address FROM parts
), listed AS (SELECT DISTINCT address FROM named WHERE regexp_matches(host, '{SPAM_HOST}') AND address <> ''),
ruled AS (SELECT *, CASE {_rule_cases()} END AS fit FROM named)
SELECT page_id, host, path, split_part(fit, ':', 1) AS rule,
  CASE WHEN fit IS NOT NULL THEN split_part(fit, ':', 2) WHEN address IN (SELECT address FROM listed) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""


DIVERGENCE = rf"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts,
    row_number() OVER () AS place FROM documents
), said AS (SELECT place, lang, source, unnest(ts) AS term FROM d),
kept AS (SELECT lang, term, count(*)::BIGINT AS n FROM said GROUP BY ALL HAVING count(DISTINCT place) >= {MIN_DOCS}),
langs AS (SELECT lang, sum(n)::BIGINT AS size, count(*)::BIGINT AS v FROM kept GROUP BY 1),
counted AS (SELECT lang, source, term, count(*)::BIGINT AS n FROM said SEMI JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT lang, source, coalesce(size, 0) AS size, coalesce(v, 0) AS v FROM (SELECT DISTINCT lang, source FROM d)
  LEFT JOIN (SELECT lang, source, sum(n)::BIGINT AS size FROM counted GROUP BY ALL) USING (lang, source) LEFT JOIN (SELECT lang, v FROM langs) USING (lang)),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + {SCALE} * (coalesce(c.n, 0) + 1) // (g.size + g.v) AS p,
    1 + {SCALE} * (k.n + 1) // (l.size + l.v) AS q
  FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), both_parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM shares WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, rank::INT AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM both_parts
) WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""


HARD_NEGATIVES = f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({VECTOR_SCALE} * x::DOUBLE)::BIGINT) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= {POSITIVES}
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)::INT AS rank, other AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND {LEAST} * positive_score <= 100 * score AND 100 * score <= {MOST} * positive_score
QUALIFY rank <= {NEGATIVES}
"""
