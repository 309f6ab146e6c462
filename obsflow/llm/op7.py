"""Query op7: passages of fifty words that an earlier document has."""

from obsflow.llm import query, substrings

SQL = r"""
WITH w AS (SELECT doc_id, [x for x in string_split_regex(text, '[ \t\n\x0B\f\r]+') if x <> ''] AS ws FROM documents),
win AS (SELECT doc_id, s, array_to_string(ws[s:s + 49], ' ') AS k
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS s FROM w WHERE len(ws) >= 50)),
f AS (SELECT k, min(doc_id) AS first FROM win GROUP BY k),
hit AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS p FROM win JOIN f USING (k) WHERE first < doc_id),
gone AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM hit GROUP BY doc_id),
word AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN hit USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, coalesce(len(ws), 0)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


@query("op7_substring_dedup", SQL)
def op7(spark, sf):
    return substrings.digest(substrings.remove_repeats(spark.read.parquet(f"{sf}/documents.parquet")))
