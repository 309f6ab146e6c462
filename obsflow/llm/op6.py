"""Query op6: near-duplicate documents on shingles of four words."""

from obsflow.llm import neardup, query

SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, [x for x in string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+') if x <> ''] AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS k
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT met.a, met.b FROM met JOIN z za ON za.doc_id = met.a JOIN z zb ON zb.doc_id = met.b WHERE 100 * c >= 80 * (za.n + zb.n - c)),
link AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(v, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT link.b, reach.c FROM reach JOIN link ON link.a = reach.v WHERE reach.c < link.b)
SELECT d.doc_id, coalesce(z.n, 0)::BIGINT AS n_shingles, r.c AS component_id, r.c = d.doc_id AS kept
FROM documents d LEFT JOIN z USING (doc_id) JOIN (SELECT v, min(c) AS c FROM reach GROUP BY v) r ON r.v = d.doc_id
"""


@query("op6_minhash_neardup", SQL)
def op6(spark, sf):
    return neardup.near_duplicates(spark.read.parquet(f"{sf}/documents.parquet"), words=4, percent=80)
