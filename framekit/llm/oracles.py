"""SQL that DuckDB can run for the queries that SQL can express."""

from __future__ import annotations

import math

from .quality_rules import ALPHA, DELTA, GRIDS

_SPACE = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

LINE_DEDUP = f"""
WITH lines AS (
    SELECT doc_id, i, line, translate(trim(line, {_SPACE}), '{_UPPER}', '{_LOWER}') AS k
    FROM (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
), hot AS (SELECT k, true AS hot FROM lines WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(hot) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (hot IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN hot USING (k) GROUP BY doc_id
"""

_RULES = ", ".join(f"('{rule}', {j}, {c}::DOUBLE)" for rule, grid in GRIDS.items() for j, c in enumerate(grid))
_P = ALPHA / len(GRIDS)
_TAIL = f"list_sum(list_transform(range(greatest(0, k - CAST(trunc(sqrt(n * {_P}) * 12 + 60) AS BIGINT)), k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * {math.log(_P)!r} + (n - i) * {math.log1p(-_P)!r})))"

QUALITY_RULES = f"""
WITH t AS (SELECT doc_id, lang AS stratum, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
grams AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM t WHERE len(w) >= 5)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1),
repeats AS (SELECT doc_id, sum(least(5, coalesce(following - i, 5))) AS n FROM (SELECT *, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS following FROM twice) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t) WHERE trim(line, {_SPACE}) <> '' GROUP BY doc_id),
f AS (
    SELECT doc_id, stratum, len(w) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        coalesce(lines.dup, 0) AS n_dup_lines, CAST(coalesce(repeats.n, 0) AS BIGINT) AS n_repeat_words, coalesce(lines.n, 0) AS n_lines
    FROM t LEFT JOIN lines USING (doc_id) LEFT JOIN repeats USING (doc_id)
),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f),
s AS (
    SELECT doc_id, stratum, base_failed, unnest(['symbols', 'duplicate_lines', 'repeated_words', 'word_length']) AS rule,
        unnest([n_symbols::DOUBLE / greatest(word_chars, 1), n_dup_lines::DOUBLE / greatest(n_lines, 1), n_repeat_words::DOUBLE / greatest(n_words, 1), word_chars::DOUBLE / greatest(n_words, 1)]) AS score
    FROM b
),
rules(rule, j, c) AS (VALUES {_RULES}),
good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
held AS (SELECT stratum, rule, j, c, count(*) AS n, count(*) FILTER (score > c) AS k FROM s JOIN good USING (doc_id) JOIN rules USING (rule) WHERE NOT base_failed GROUP BY ALL),
tested AS (SELECT *, CASE WHEN k >= n * {_P} THEN false ELSE {_TAIL} <= {DELTA / len(GRIDS)} / (SELECT count(*) FROM (SELECT DISTINCT stratum FROM held)) END AS ok FROM held),
depth AS (SELECT stratum, rule, coalesce(min(j) FILTER (NOT ok), max(j) + 1) AS d FROM tested GROUP BY stratum, rule),
cutoffs AS (SELECT depth.stratum, depth.rule, rules.c FROM depth JOIN rules ON rules.rule = depth.rule AND rules.j = d - 1),
rejected AS (SELECT DISTINCT doc_id FROM s JOIN cutoffs ON s.rule = cutoffs.rule AND s.stratum IS NOT DISTINCT FROM cutoffs.stratum WHERE score > c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM rejected) AS kept FROM b
"""

ORACLES = {"op1_quality_rules": QUALITY_RULES, "op9_line_dedup": LINE_DEDUP}
