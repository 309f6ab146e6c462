"""Query op10: documents sampled to tempered source, language and topic shares."""

from obsflow.llm import mixing, query

# Enough for the margins of any of the test tables to be met to more than the digits shown.
_ROUNDS = 60
_MARGINS = ["source", "lang", "topic"]
_TOPIC = "CASE " + " ".join(f"WHEN contains(text, '{s}') THEN '{t}'" for t, s in mixing.TOPICS) + " ELSE 'prose' END"


def _rounds() -> str:
    out, last = [], "r0"
    for i in range(_ROUNDS):
        for m in _MARGINS:
            new = f"r{i + 1}_{m}"
            out.append(f"{new} AS MATERIALIZED (SELECT * REPLACE (coalesce(raked * to_{m} * total / nullif(sum(raked) OVER (PARTITION BY {m}), 0), 0) AS raked) FROM {last})")
            last = new
    return ",\n".join(out) + f",\nr AS (SELECT *, CASE WHEN tokens > 0 THEN raked / tokens ELSE 1 END AS weight FROM {last})"


def _target(m: str) -> str:
    return f"t_{m} AS (SELECT {m}, s / sum(s) OVER () AS to_{m} FROM (SELECT {m}, pow(sum(tokens)::DOUBLE, {mixing.TEMPER}) AS s FROM cells GROUP BY {m}))"


SQL = rf"""
WITH d AS (SELECT doc_id, source, lang, {_TOPIC} AS topic, len([x for x in string_split_regex(text, '[ \t\n\x0B\f\r]+') if x <> ''])::BIGINT AS n_tokens
           FROM (SELECT doc_id, source, lang, coalesce(text, '') AS text FROM documents)),
cells AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY ALL),
{", ".join(_target(m) for m in _MARGINS)},
r0 AS MATERIALIZED (SELECT cells.*, tokens::DOUBLE AS raked, (SELECT sum(tokens)::DOUBLE FROM cells) AS total, to_source, to_lang, to_topic FROM cells
       JOIN t_source ON t_source.source IS NOT DISTINCT FROM cells.source JOIN t_lang ON t_lang.lang IS NOT DISTINCT FROM cells.lang JOIN t_topic ON t_topic.topic = cells.topic),
{_rounds()},
lim AS (SELECT r.weight, ({mixing.SHARE} * total - sum(CASE WHEN o.weight > r.weight THEN o.tokens ELSE 0 END)) / sum(CASE WHEN o.weight > r.weight THEN 0 ELSE o.raked END) AS s
        FROM r, (SELECT weight, tokens, raked FROM r) o GROUP BY r.weight, total),
sc AS (SELECT arg_max(s, weight) AS s FROM lim WHERE s * weight <= 1 AND s >= 0),
p AS (SELECT source, lang, topic, weight, coalesce(least(1.0, s * weight), 1.0) AS probability FROM r, sc)
SELECT d.doc_id, d.source, d.lang, d.topic, n_tokens, round(weight, 6) AS weight, round(probability, 6) AS probability,
       ('0x' || substr(md5(d.doc_id::VARCHAR), 1, 8))::BIGINT / 4294967296 < probability AS kept
FROM d JOIN p ON p.source IS NOT DISTINCT FROM d.source AND p.lang IS NOT DISTINCT FROM d.lang AND p.topic = d.topic
"""


@query("op10_mixing", SQL)
def op10(spark, sf):
    return mixing.mixed(spark.read.parquet(f"{sf}/documents.parquet"))
