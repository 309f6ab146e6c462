"""Query op13: embeddings as codes of sixteen parts."""

from obsflow.llm import codes, query


def _nearest(book: str) -> str:
    return f"""SELECT vec_id, p, min(list_sum([z[1] * z[1] for z in [[v[i] - w[i]] for i in range(1, len(v) + 1)]])::HUGEINT * 64 + e) AS k
 FROM part JOIN {book} USING (p) GROUP BY vec_id, p"""


def _moved(book: str, near: str) -> str:
    # Floors of quotients, also for negative sums.
    return f"""SELECT p, e, coalesce(m.w, b.w) AS w FROM {book} b LEFT JOIN (
  SELECT p, e, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS w FROM (
   SELECT p, (k % 64)::BIGINT AS e, i, sum(v[i]) AS s, count(*) AS n FROM part JOIN {near} USING (vec_id, p), (SELECT unnest(range(1, (SELECT max(len(v)) + 1 FROM part))) AS i) GROUP BY 1, 2, 3
  ) GROUP BY p, e) m USING (p, e)"""


SQL = f"""
WITH kept AS (SELECT vec_id, label, [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
 WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
part AS (SELECT vec_id, p, v[p * (len(v) // 16) + 1:(p + 1) * (len(v) // 16)] AS v FROM kept, (SELECT unnest(range(16)) AS p)),
b0 AS (SELECT p, e, v AS w FROM part JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept) USING (vec_id) WHERE e < 64),
n0 AS MATERIALIZED ({_nearest("b0")}),
b1 AS MATERIALIZED ({_moved("b0", "n0")}),
n1 AS MATERIALIZED ({_nearest("b1")}),
b2 AS MATERIALIZED ({_moved("b1", "n1")}),
n2 AS MATERIALIZED ({_nearest("b2")}),
code AS (SELECT vec_id, string_agg(printf('%02x', (k % 64)::BIGINT), '' ORDER BY p) AS code, sum(k // 64)::BIGINT AS error FROM n2 GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
 (SELECT sha256(string_agg(array_to_string(w, ','), ',' ORDER BY p, e)) FROM b2) AS codebooks_sha256
FROM kept JOIN code USING (vec_id)
"""


@query("op13_vector_codes", SQL)
def op13(spark, sf):
    return codes.compressed(spark.read.parquet(f"{sf}/embeddings.parquet")).drop("label")
