"""Query op12: phrases whose words belong together, by language."""

from obsflow.llm import phrases, query

SQL = r"""
WITH pieces AS (SELECT row_number() OVER () AS id, lang, [x for x in string_split_regex(p, '[ \t]+') if x <> ''] AS w
 FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\f\r]')) AS p FROM documents)),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
word AS (SELECT id, lang, unnest(w) AS x, unnest(range(len(w))) AS i FROM pieces),
near AS (SELECT lang, x, lead(x) OVER p AS x2, lead(x, 2) OVER p AS x3, lead(x, 3) OVER p AS x4 FROM word WINDOW p AS (PARTITION BY id ORDER BY i)),
f AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS a FROM (SELECT lang, unnest([1, 2, 3, 4]) AS m, unnest([x, x || ' ' || x2, x || ' ' || x2 || ' ' || x3, x || ' ' || x2 || ' ' || x3 || ' ' || x4]) AS phrase FROM near)
 WHERE phrase IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 30),
cand AS (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
cut AS MATERIALIZED (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS h, array_to_string(w[k + 1:], ' ') AS t FROM (SELECT *, unnest(range(1, m)) AS k FROM cand)),
cuts AS (SELECT cut.lang, cut.phrase, cut.a, k, l.a AS l, r.a AS r, (2000000::HUGEINT * cut.a // (l.a + r.a))::BIGINT AS score
 FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = h JOIN f r ON r.lang = cut.lang AND r.phrase = t),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
runs AS (SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(a) AS longer
 FROM (SELECT lang, a, w, s, unnest(range(1, m - s + 2)) AS i FROM cand, (SELECT unnest([2, 3]) AS s) WHERE s < m) GROUP BY 1, 2),
kept AS (SELECT best.* FROM best LEFT JOIN runs USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN total USING (lang) QUALIFY rank <= 2000
"""


@query("op12_phrases", SQL)
def op12(spark, sf):
    return phrases.collocations(spark.read.parquet(f"{sf}/documents.parquet"))
