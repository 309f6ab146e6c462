"""Query op9: conversations in reply order, without quotations."""

from obsflow.llm import chat, query

SQL = r"""
WITH RECURSIVE m AS (SELECT conv_id, turn, role, string_split(coalesce(text, ''), chr(10)) AS ls FROM conversations),
l AS (SELECT conv_id, turn, i, raw, len(mark) - len(replace(mark, '>', '')) AS d, lower(trim(regexp_replace(substr(raw, len(mark) + 1), '[ \t\x0B\f\r]+', ' ', 'g'), ' ')) AS t
      FROM (SELECT *, regexp_extract(raw, '^((?:[ \t]*>)+)', 1) AS mark FROM (SELECT conv_id, turn, unnest(ls) AS raw, unnest(range(len(ls))) AS i FROM m))),
r AS (SELECT *, sum(new) OVER (PARTITION BY conv_id, turn ORDER BY i) AS run FROM (SELECT *, CASE WHEN d IS DISTINCT FROM lag(d) OVER (PARTITION BY conv_id, turn ORDER BY i) THEN 1 ELSE 0 END AS new FROM l)),
whole AS (SELECT conv_id, turn, min(d) AS d, string_agg(t, chr(10) ORDER BY i) AS t FROM r WHERE t <> '' GROUP BY conv_id, turn, CASE WHEN d = 0 THEN -1 ELSE run END HAVING count(*) > 1),
k AS (SELECT conv_id, turn, d, md5(t) AS key FROM r WHERE t <> '' UNION SELECT conv_id, turn, d, md5(t) FROM whole),
o AS (SELECT conv_id, key, min(turn) AS first FROM k WHERE d = 0 GROUP BY ALL),
h AS (SELECT conv_id, turn, d, first, count(*) AS n FROM k JOIN o USING (conv_id, key) WHERE d > 0 AND first < turn GROUP BY ALL),
p AS (SELECT conv_id, turn, arg_max(first, (-d, n, first)) AS parent FROM h GROUP BY conv_id, turn),
up(conv_id, turn, node, path) AS (SELECT conv_id, turn, turn, turn::VARCHAR FROM m
    UNION ALL SELECT up.conv_id, up.turn, p.parent, p.parent::VARCHAR || '/' || up.path FROM up JOIN p ON p.conv_id = up.conv_id AND p.turn = up.node),
best AS (SELECT conv_id, turn, arg_max(path, len(path)) AS reply_path FROM up GROUP BY conv_id, turn),
b AS (SELECT conv_id, turn, regexp_replace(coalesce(string_agg(raw, chr(10) ORDER BY i) FILTER (d = 0), ''), '^\n+|\n+$', '', 'g') AS body, count(*) FILTER (d > 0) AS n_quoted FROM l GROUP BY conv_id, turn)
SELECT conv_id, turn, role, body, n_quoted, parent AS parent_turn, reply_path, '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || body || chr(10) || '<|end|>' AS formatted
FROM m JOIN b USING (conv_id, turn) JOIN best USING (conv_id, turn) LEFT JOIN p USING (conv_id, turn)
"""


@query("op9_reply_order", SQL)
def op9(spark, sf):
    return chat.reply_ordered(spark.read.parquet(f"{sf}/conversations.parquet"))
