"""Query op5: counts of every document, base rules and risk-controlled rules."""

from obsflow.llm import quality, query

_TESTS = ", ".join(f"('{r}', {c})" for r, (_, _, cs) in quality.RULES.items() for c in cs)
_REJECTS = "CASE rule " + " ".join(f"WHEN '{r}' THEN 1000 * {a} > cutoff * {b}" for r, (a, b, _) in quality.RULES.items()) + " END"
_RATE = quality.LIMIT / len(quality.RULES)
SQL = rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, lang, text, [x for x in string_split_regex(text, '[ \t\n\x0B\f\r]+') if x <> ''] AS ws,
             [x for x in string_split(text, chr(10)) if regexp_matches(x, '[^ \t\n\x0B\f\r]')] AS ls FROM d),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 2], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
rep AS (SELECT doc_id, i FROM win JOIN (SELECT doc_id, k FROM win GROUP BY ALL HAVING count(*) > 1) USING (doc_id, k)),
cov AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
f AS (SELECT doc_id, lang, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[ \t\n\x0B\f\r]', '', 'g'))::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
t AS (SELECT lang, rule, cutoff, count(*) FILTER (quality = 1) AS n, count(*) FILTER (quality = 1 AND {_REJECTS}) AS k,
             count(*) FILTER (quality <> 1) AS nb, count(*) FILTER (quality <> 1 AND {_REJECTS}) AS kb
      FROM b JOIN labels USING (doc_id), (VALUES {_TESTS}) v(rule, cutoff) WHERE NOT base_failed AND quality IS NOT NULL GROUP BY ALL),
c AS (SELECT *, CASE WHEN k >= n * {_RATE!r} THEN 1 ELSE
        list_sum([exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({_RATE!r}) + (n - j) * ln({1 - _RATE!r})) for j in range(0, k + 1)]) END AS p,
        (SELECT count(*) FROM t) AS m FROM t),
s AS (SELECT lang, rule, arg_max(cutoff, (kb * n - k * nb, cutoff)) AS cutoff FROM c WHERE p <= {quality.ERROR} / m AND kb * n > k * nb AND kb * n >= {quality.LIFT} * k * nb GROUP BY ALL),
bad AS (SELECT DISTINCT doc_id FROM b JOIN s ON b.lang IS NOT DISTINCT FROM s.lang WHERE {_REJECTS})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM b
"""


@query("op5_quality_rules", SQL)
def op5(spark, sf):
    return quality.rule_verdicts(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
