"""Numbered-sequence, rule and projection queries."""

from pyspark.sql import functions as F

from bindings import query, table
from bindings.reconcile import bars
from bindings.streams import EV, LINE_ORDER, ev
from obsflow.operators import numbered as n
from obsflow.operators import reconcile as r
from obsflow.operators import rules as p
from obsflow.plans.ordered import dealt

ORDER = ["l_orderkey"]
TIE = ["l_partkey", "l_suppkey"]

BOUNDS = """b0 AS (SELECT l_orderkey, l_linenumber, min(l_quantity) AS q FROM lineitem GROUP BY ALL),
bd AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS i, 40 + 210.0::DOUBLE * l_linenumber AS x, CASE WHEN q <= 40 THEN CAST(l_linenumber AS BIGINT) END AS n FROM b0)"""


def boundaries(spark, sf):
    l, deal = dealt(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), ORDER)
    d = l.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("q"))
    return d.select("l_orderkey", "l_linenumber", (40 + F.col("l_linenumber") * 210.0).alias("x"), F.when(F.col("q") <= 40, F.col("l_linenumber")).alias("label")), deal


def widths(spark):
    return spark.createDataFrame([(k, 210.0) for k in (1, 2, 3, 5, 6)], "number int, width double")


VERIFY = "WITH " + BOUNDS + """, kn AS (SELECT l_orderkey, i, x, n, lead(i) OVER w AS j, lead(x) OVER w AS xx, lead(n) OVER w AS nn FROM bd WHERE n IS NOT NULL WINDOW w AS (PARTITION BY l_orderkey ORDER BY i)),
ok AS (SELECT *, n + (k - i) AS num FROM (SELECT *, unnest(range(i, j + 1)) AS k FROM kn WHERE nn - n = j - i AND j - i <= 3)),
v AS (SELECT l_orderkey, k AS i, max(num) AS num FROM ok GROUP BY ALL)
"""


@query("verify_numbering", VERIFY + "SELECT l_orderkey, x, num AS number, false AS inferred FROM bd LEFT JOIN v USING (l_orderkey, i)")
def _(spark, sf):
    d, deal = boundaries(spark, sf)
    return n.verify_numbering(d, ORDER, ["l_linenumber"], "x", "label", deal=deal)


@query("verify_numbering_widths", VERIFY + """, gp AS (SELECT l_orderkey, i, j, n, nn, x, xx FROM kn WHERE j - i >= 1 AND j - i < nn - n AND nn - n <= 3),
pt AS (SELECT gp.*, g.q, w FROM gp, LATERAL (SELECT unnest(range(n, nn)) AS q) g LEFT JOIN (VALUES (1, 210.0::DOUBLE), (2, 210.0), (3, 210.0), (5, 210.0), (6, 210.0)) wd(num, w) ON wd.num = g.q),
sm AS (SELECT l_orderkey, i, count(*) FILTER (WHERE w IS NULL) AS un, coalesce(sum(w), 0) AS sw, any_value(x) AS x, any_value(xx) AS xx, any_value(j) AS j, any_value(nn) AS nn FROM pt GROUP BY ALL),
gd AS (SELECT * FROM sm WHERE un <= 1 AND CASE WHEN un = 1 THEN xx - x - sw > 30 AND xx - x - sw < 650 ELSE abs(sw - (xx - x)) <= greatest(4, (xx - x) * 0.02) END),
ps AS (SELECT pt.l_orderkey, pt.i, pt.q AS num, gd.x + coalesce(sum(coalesce(w, gd.xx - gd.x - gd.sw)) OVER (PARTITION BY pt.l_orderkey, pt.i ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p, gd.j FROM pt JOIN gd ON pt.l_orderkey = gd.l_orderkey AND pt.i = gd.i
 UNION ALL SELECT l_orderkey, i, nn, xx, j FROM gd),
mt AS (SELECT bd.l_orderkey, ps.i AS gi, bd.i, ps.num, abs(ps.p - bd.x) AS d FROM bd JOIN ps ON bd.l_orderkey = ps.l_orderkey AND bd.i BETWEEN ps.i AND ps.j),
nr AS (SELECT * FROM mt QUALIFY row_number() OVER (PARTITION BY l_orderkey, gi, i ORDER BY d, num) = 1),
fine AS (SELECT l_orderkey, gi FROM nr GROUP BY ALL HAVING max(d) < 4),
fx AS (SELECT l_orderkey, i, max(num) AS f FROM nr JOIN fine USING (l_orderkey, gi) GROUP BY ALL)
SELECT l_orderkey, x, coalesce(f, num) AS number, false AS inferred FROM bd LEFT JOIN v USING (l_orderkey, i) LEFT JOIN fx USING (l_orderkey, i)
UNION ALL SELECT ps.l_orderkey, ps.p, ps.num, true FROM ps JOIN fine ON fine.l_orderkey = ps.l_orderkey AND fine.gi = ps.i WHERE NOT EXISTS (SELECT 1 FROM nr WHERE nr.l_orderkey = ps.l_orderkey AND nr.gi = ps.i AND nr.num = ps.num)""")
def _(spark, sf):
    d, deal = boundaries(spark, sf)
    return n.verify_numbering(d, ORDER, ["l_linenumber"], "x", "label", widths(spark), deal=deal)


@query("propagate_by_width", "WITH RECURSIVE " + BOUNDS + """, wd(num, w) AS (VALUES (1, 210.0::DOUBLE), (2, 210.0), (3, 210.0), (5, 210.0), (6, 210.0)),
z AS (SELECT *, max(i) OVER (PARTITION BY l_orderkey) AS k FROM bd),
f AS (SELECT l_orderkey, i, x, n, 0 AS d FROM z WHERE i = 1
 UNION ALL SELECT s.l_orderkey, s.i, s.x, coalesce(s.n, CASE WHEN abs(s.x - f.x - w) <= greatest(4, w * 0.02) THEN f.n + 1 END), CASE WHEN s.n IS NULL THEN f.d + 1 ELSE 0 END FROM f JOIN z s ON s.l_orderkey = f.l_orderkey AND s.i = f.i + 1 LEFT JOIN wd ON wd.num = f.n),
g AS (SELECT l_orderkey, i, x, n, 0 AS d FROM z WHERE i = k
 UNION ALL SELECT s.l_orderkey, s.i, s.x, coalesce(s.n, CASE WHEN g.n > 1 AND abs(g.x - s.x - w) <= greatest(4, w * 0.02) THEN g.n - 1 END), CASE WHEN s.n IS NULL THEN g.d + 1 ELSE 0 END FROM g JOIN z s ON s.l_orderkey = g.l_orderkey AND s.i = g.i - 1 LEFT JOIN wd ON wd.num = g.n - 1)
SELECT l_orderkey, f.x, CASE WHEN f.n IS NULL THEN g.n WHEN g.n IS NULL OR f.d <= g.d THEN f.n ELSE g.n END AS number FROM f JOIN g USING (l_orderkey, i)""")
def _(spark, sf):
    d = boundaries(spark, sf)[0].select("l_orderkey", "x", F.col("label").cast("bigint").alias("number"))
    return n.propagate_by_width(d, ORDER, "x", "number", widths(spark), []).select("l_orderkey", "x", "number")


@query("fill_boundaries", "WITH " + BOUNDS + """, wd(num, w) AS (VALUES (1, 210.0::DOUBLE), (2, 210.0), (3, 105.0), (5, 210.0), (6, 230.0)),
sn AS (SELECT DISTINCT o_orderkey AS l_orderkey, CAST(o_custkey % 8 AS BIGINT) AS number FROM orders),
p AS (SELECT bd.l_orderkey, i, x, n, lag(n) OVER w + 1 AS fl, lead(n) OVER w - 1 AS fr, lead(n) OVER w AS nn FROM bd WINDOW w AS (PARTITION BY l_orderkey ORDER BY i)),
f AS (SELECT p.l_orderkey, i, x, coalesce(n, CASE WHEN a.number IS NOT NULL OR i % 4 = 0 THEN fl END, CASE WHEN b.number IS NOT NULL THEN fr END, CASE WHEN i = 1 AND nn = 2 AND x < 260 THEN 1 END) AS n
 FROM p LEFT JOIN sn a ON a.l_orderkey = p.l_orderkey AND a.number = fl LEFT JOIN sn b ON b.l_orderkey = p.l_orderkey AND b.number = fr),
g AS (SELECT f.*, o.w AS own, v.w AS prev FROM f LEFT JOIN wd o ON o.num = f.n LEFT JOIN wd v ON v.num = f.n - 1),
h AS (SELECT *, lag(x + own) OVER w AS ta, lag(n) OVER w AS na, lead(x - prev) OVER w AS tb, lead(n) OVER w AS nb, lead(x) OVER w AS xb, lag(x) OVER w AS xa FROM g WINDOW w AS (PARTITION BY l_orderkey ORDER BY i))
SELECT l_orderkey, x, CAST(coalesce(n, CASE WHEN abs(ta - x) < 4 THEN na + 1 END, CASE WHEN abs(tb - x) < 4 AND nb > 1 THEN nb - 1 END) AS BIGINT) AS number, false AS inferred FROM h
UNION ALL SELECT l_orderkey, round_even(x + own, 0), n + 1, true FROM h WHERE x + own BETWEEN 0 AND 1299.999 AND (xb IS NULL OR x + own <= xb - 4)
UNION ALL SELECT l_orderkey, round_even(tb, 0), nb - 1, true FROM h WHERE tb >= x + 4 AND tb < 1300 AND nb > 1 AND NOT coalesce(x + own BETWEEN 0 AND 1299.999 AND x + own <= xb - 4, false)
UNION ALL SELECT l_orderkey, round_even(x - prev, 0), n - 1, true FROM h WHERE xa IS NULL AND x - prev >= 0 AND n > 1""")
def _(spark, sf):
    from obsflow.plans.ordered import Ordered, row_number
    d, deal = boundaries(spark, sf)
    d = d.select("l_orderkey", "x", F.col("label").cast("bigint").alias("number"))
    d = Ordered(d, ORDER, ["x"], chunked=deal.chunked).with_columns(i=row_number()).result
    w = spark.createDataFrame([(1, 210.0), (2, 210.0), (3, 105.0), (5, 210.0), (6, 230.0)], "number int, width double")
    seen = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 8).alias("number"))
    return n.fill_boundaries(d, ORDER, "x", "number", w, [], 1300.0, seen=seen, double=F.col("i") % 4 == 0, opening=F.lit(True), deal=deal)


@query("width_consensus", """WITH RECURSIVE s AS (SELECT l_partkey AS number, l_quantity AS w, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey) AS i FROM lineitem),
f AS (SELECT number, i, w AS c, [w] AS cs FROM s WHERE i = 1
 UNION ALL SELECT s.number, s.i, coalesce(hit, s.w), CASE WHEN hit IS NULL THEN list_append(cs, s.w) ELSE cs END FROM f JOIN s ON s.number = f.number AND s.i = f.i + 1,
 LATERAL (SELECT list_filter(cs, lambda q: abs(q - s.w) <= greatest(3, s.w * 0.02))[1] AS hit) z),
g AS (SELECT number, c AS width, count(*) AS n, min(i) AS f1 FROM f GROUP BY ALL)
SELECT number, width, n AS count, n >= 4 AS trusted FROM g QUALIFY row_number() OVER (PARTITION BY number ORDER BY n DESC, f1) = 1""")
def _(spark, sf):
    d = table(spark, sf, "lineitem").withColumnRenamed("l_partkey", "number")
    return n.width_consensus(d, [], "number", "l_quantity", ["l_orderkey", "l_linenumber", "l_suppkey"], 4)


@query("best_patch", """WITH RECURSIVE s AS (SELECT l_partkey, l_quantity AS q, l_orderkey AS src, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey) AS i FROM lineitem),
f AS (SELECT l_partkey, i, q, src FROM s WHERE i = 1 UNION ALL SELECT s.l_partkey, s.i, CASE WHEN s.q + 8 < f.q THEN s.q ELSE f.q END, CASE WHEN s.q + 8 < f.q THEN s.src ELSE f.src END FROM f JOIN s ON s.l_partkey = f.l_partkey AND s.i = f.i + 1)
SELECT l_partkey, q AS l_quantity, src AS l_orderkey FROM f QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY i DESC) = 1""")
def _(spark, sf):
    d = table(spark, sf, "lineitem").select("l_partkey", "l_quantity", "l_orderkey", "l_linenumber", "l_suppkey")
    return n.best_patch(d, ["l_partkey"], "l_quantity", ["l_orderkey", "l_linenumber", "l_suppkey"], ["l_orderkey"])


@query("vote_transient", "WITH " + EV + """, b AS (SELECT user_id, event_type, value, round_even(t / 43200, 0) AS b, t, event_id FROM ev QUALIFY row_number() OVER (PARTITION BY user_id, event_type, b ORDER BY t, event_id) = 1),
g AS (SELECT user_id, event_type, count(*) FILTER (WHERE value < 150) AS clear, count(*) FILTER (WHERE value < 20) AS support FROM b GROUP BY ALL)
SELECT *, clear >= 3 AND support < clear * 0.3 AS drop FROM g""")
def _(spark, sf):
    return n.vote_transient(ev(spark, sf), ["user_id"], "event_type", "t", ["event_id"], F.col("value") < 150, F.col("value") < 20, per_second=1 / 43200)


@query("backward_reset", """WITH f AS (SELECT l_orderkey, l_linenumber AS x, lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_linenumber) AS p FROM lineitem)
SELECT l_orderkey, bool_or(coalesce(x < p - 1, false)) AS backward FROM f GROUP BY 1""")
def _(spark, sf):
    d = table(spark, sf, "lineitem").withColumn("numbers", F.array("l_linenumber"))
    return n.backward_reset(d, ORDER, ["l_shipdate", *TIE, "l_linenumber"], "numbers")


@query("gap_report", """WITH d AS (SELECT DISTINCT o_custkey AS k, l_linenumber AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey), s AS (SELECT k, count(*) AS c, CASE WHEN min(n) <= 8 THEN 1 ELSE min(n) END AS lo, max(n) AS hi FROM d GROUP BY 1),
x AS (SELECT *, c < 4 OR hi - lo + 1 - c > 3 AS declined FROM s)
SELECT k, CAST(NULL AS BIGINT) AS missing, declined FROM x WHERE declined
UNION ALL (SELECT k, unnest(range(lo, hi + 1)), declined FROM x WHERE NOT declined EXCEPT SELECT k, n, false FROM d)""")
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("l_orderkey"))
    d = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").join(o, "l_orderkey")
    return n.gap_report(d, ["k"], "l_linenumber", least=4)


@query("group_consecutive", """WITH d AS (SELECT l_orderkey, l_linenumber AS n, CAST(min(l_quantity) AS DOUBLE) AS w FROM lineitem GROUP BY ALL),
s AS (SELECT *, n - row_number() OVER (PARTITION BY l_orderkey ORDER BY n) AS g FROM d), c AS (SELECT *, (row_number() OVER (PARTITION BY l_orderkey, g ORDER BY n) - 1) // 4 AS c FROM s),
r AS (SELECT *, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY g, c) AS row FROM c)
SELECT l_orderkey, row, string_agg(n::VARCHAR, ',' ORDER BY n) AS numbers, '0,' || array_to_string(list_transform(range(1, count(*) + 1), lambda i: CAST(list_sum(list(w ORDER BY n)[1:i]) AS BIGINT)), ',') AS bounds FROM r GROUP BY ALL""")
def _(spark, sf):
    d = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("w"))
    out = n.group_consecutive(d, ORDER, "l_linenumber", "w")
    return out.select("l_orderkey", "row", F.array_join(F.transform("numbers", lambda x: x.cast("string")), ",").alias("numbers"),
                      F.array_join(F.transform("bounds", lambda x: x.cast("bigint").cast("string")), ",").alias("bounds"))


@query("weak_items", "SELECT l_partkey, avg(CASE WHEN l_quantity > 40 THEN 1 ELSE 0 END) AS share FROM lineitem GROUP BY 1 HAVING avg(CASE WHEN l_quantity > 40 THEN 1 ELSE 0 END) > 0.12")
def _(spark, sf):
    return n.weak_items(table(spark, sf, "lineitem"), ["l_partkey"], "l_quantity", 40)


@query("unresolved_tail", "WITH " + EV + """, d AS (SELECT *, CAST(floor(value / 20) AS BIGINT) AS n, max(t) OVER (PARTITION BY user_id) AS e FROM ev), l AS (SELECT user_id, max(n) FILTER (WHERE t < e - 864000) AS last FROM d GROUP BY 1),
c AS (SELECT d.user_id, d.t FROM d JOIN l USING (user_id) WHERE t >= e - 864000 AND event_type IN ('view', 'click', 'error') AND n % 4 = (last + 1) % 4 QUALIFY row_number() OVER (PARTITION BY d.user_id ORDER BY value, t, event_id) = 1)
SELECT user_id, c.t, CASE WHEN c.t IS NULL THEN 'check the ending' END AS warning FROM l LEFT JOIN c USING (user_id)""".replace("n % 4 = (last + 1) % 4", "n = last + 1"))
def _(spark, sf):
    d = ev(spark, sf).withColumn("n", F.floor(F.col("value") / 20))
    return n.unresolved_tail(d, ["user_id"], "t", "value", "n", F.col("event_type").isin("view", "click", "error"), ["event_id"], 864000.0)


@query("numbered_gate", """WITH q AS (SELECT l_orderkey, l_returnflag, count(*) AS n, min(l_linenumber) AS f FROM lineitem GROUP BY ALL)
SELECT l_orderkey, coalesce(count(*) FILTER (WHERE n >= 2) >= 2 AND max(f) FILTER (WHERE n >= 2) > min(f) FILTER (WHERE n >= 2), false) AS numbered FROM q GROUP BY 1""")
def _(spark, sf):
    d = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.min("l_linenumber").alias("f"))
    return n.numbered_gate(d, ORDER, "n", "f")


@query("crop_box", """WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount * 5 AS l, l_tax * 10 AS t, l_quantity / 50 AS r, l_quantity / 48 AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(trunc(l * 640) AS INTEGER) AS x0, CAST(trunc(t * 360) AS INTEGER) AS y0, CAST(greatest(trunc(r * 640), trunc(l * 640) + 1) AS INTEGER) AS x1, CAST(greatest(trunc(b * 360), trunc(t * 360) + 1) AS INTEGER) AS y1
FROM c WHERE l < r AND r <= 1 AND t < b AND b <= 1""")
def _(spark, sf):
    crop = [F.col("l_discount") * 5, F.col("l_tax") * 10, F.col("l_quantity") / 50, F.col("l_quantity") / 48]
    d = table(spark, sf, "lineitem").select("l_orderkey", *LINE_ORDER, p.crop_box(crop, F.lit(640), F.lit(360)).alias("box"))
    return d.filter("box is not null").select("l_orderkey", *LINE_ORDER, "box.*")


@query("expand_crop", """WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount * 5 AS l, l_tax * 10 AS t, l_quantity / 50 AS r, l_quantity / 48 AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN ok THEN greatest(0, l - 0.035::DOUBLE) END AS x0, CASE WHEN ok THEN greatest(0, t - 0.075::DOUBLE) END AS y0, CASE WHEN ok THEN least(1, r + 0.035::DOUBLE) END AS x1, CASE WHEN ok THEN least(1, b + 0.075::DOUBLE) END AS y1
FROM c, LATERAL (SELECT l < r AND r <= 1 AND t < b AND b <= 1 AS ok) z""")
def _(spark, sf):
    crop = [F.col("l_discount") * 5, F.col("l_tax") * 10, F.col("l_quantity") / 50, F.col("l_quantity") / 48]
    d = table(spark, sf, "lineitem").select("l_orderkey", *LINE_ORDER, p.expand_crop(crop).alias("c"))
    return d.select("l_orderkey", *LINE_ORDER, *[F.get("c", F.lit(i)).alias(k) for i, k in enumerate(("x0", "y0", "x1", "y1"))])


@query("canonical_video_url", r"""WITH u AS (SELECT page_id, trim(url) AS url, lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) AS host, string_split(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/') AS pt, regexp_extract(url, '\?([^#]*)', 1) AS q FROM pages),
h AS (SELECT *, host IN (SELECT regexp_extract(url, '^https?://([^/?#]*)', 1) FROM pages WHERE url LIKE 'https://%example.com/%') AS good,
 CASE WHEN pt[2] IN ('en', 'fr') AND len(pt) > 2 THEN pt[3] ELSE nullif(regexp_extract(q, '(^|&)page=([^&]*)', 2), '') END AS item FROM u)
SELECT page_id, CASE WHEN good AND regexp_matches(item, '^[0-9]{2,3}$') THEN item END AS item_id, CASE WHEN good AND regexp_matches(item, '^[0-9]{2,3}$') THEN 'https://example.org/item?id=' || item END AS canonical,
 CASE WHEN NOT good THEN 'unsupported address' WHEN NOT coalesce(regexp_matches(item, '^[0-9]{2,3}$'), false) THEN 'no single item' END AS error FROM h""".replace(
    "host IN (SELECT regexp_extract(url, '^https?://([^/?#]*)', 1) FROM pages WHERE url LIKE 'https://%example.com/%')", "host IN ('m.ththth.example.net', 'm.therou.example.com', 'ththre.example.com', 'blog.tiontion.example.com', 'blog.ththan.example.net', 'spam-farm.example.org')"))
def _(spark, sf):
    hosts = ["m.ththth.example.net", "m.therou.example.com", "ththre.example.com", "blog.tiontion.example.com", "blog.ththan.example.net", "spam-farm.example.org"]
    d = table(spark, sf, "pages").select("page_id", "url")
    return p.canonical_video_url(d, "url", hosts, [], ["en", "fr"], "page", "[0-9]{2,3}", "https://example.org/item?id=").drop("url")


@query("safe_name", r"""WITH c AS (SELECT doc_id, regexp_replace(text, '[<>:"/\\|?*\x00-\x1f]', '_', 'g') AS a FROM documents), t AS (SELECT doc_id, substr(regexp_replace(a, '^[. ]+|[. ]+$', '', 'g'), 1, 100) AS b FROM c),
d AS (SELECT doc_id, CASE WHEN b = '' THEN 'Sheet music' ELSE b END AS b FROM t)
SELECT doc_id, CASE WHEN upper(string_split(b, '.')[1]) IN ('CON', 'PRN', 'AUX', 'NUL', 'COM1', 'LPT1') THEN '_' || b ELSE b END AS name FROM d""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", p.safe_name(F.col("text")).alias("name"))


@query("range_rules", """WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, unnest(['bpm', 'beats', 'bar_override', 'height_scale']) AS field, unnest([l_quantity * 8, l_quantity / 2, l_quantity / 2, CASE WHEN l_tax = 0 THEN NULL ELSE l_discount * 30 END]) AS value, unnest([30, 1, 0, 0.25]) AS lo, unnest([300, 16, 16, 2]) AS hi FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, field, value, CASE WHEN value IS NULL THEN 'not finite' WHEN value NOT BETWEEN lo AND hi THEN 'out of range' ELSE 'not whole' END AS rule FROM v
WHERE value IS NULL OR value NOT BETWEEN lo AND hi OR (field = 'bar_override' AND value <> floor(value))""")
def _(spark, sf):
    d = table(spark, sf, "lineitem").select("l_orderkey", *LINE_ORDER, (F.col("l_quantity") * 8).alias("bpm"), (F.col("l_quantity") / 2).alias("beats"),
                                            (F.col("l_quantity") / 2).alias("bar_override"), F.when(F.col("l_tax") != 0, F.col("l_discount") * 30).alias("height_scale"))
    return p.range_rules(d, ["l_orderkey", *LINE_ORDER], ["bpm", "beats", "bar_override", "height_scale"])


SCHEMA = {"type": "object", "properties": {"k": {"type": "integer"}, "kind": {"type": "string", "enum": ["view", "click", "error"]}, "tags": {"type": "array", "items": {"type": "number"}}}}


@query("schema_check", """WITH j AS (SELECT event_id, event_type AS e FROM events)
SELECT event_id, 'response.k' AS path, 'expected integer' AS issue FROM j WHERE e = 'click'
UNION ALL SELECT event_id, 'response', 'missing or unexpected fields' FROM j WHERE e IN ('purchase', 'error')
UNION ALL SELECT event_id, 'response.kind', 'unsupported value' FROM j WHERE e IN ('signup', 'purchase')
UNION ALL SELECT event_id, 'response.tags[1]', 'expected number' FROM j WHERE e = 'view'
UNION ALL SELECT event_id, 'response.tags', 'expected array' FROM j WHERE e = 'signup'
UNION ALL SELECT event_id, 'response.k', 'expected integer' FROM j WHERE e = 'error'""")
def _(spark, sf):
    e = F.col("event_type")
    k = F.get_json_object("props", "$.k")
    body = (F.when(e == "click", F.concat(F.lit('{"k": "'), k, F.lit('", "kind": "click", "tags": []}')))
            .when(e == "purchase", F.lit('{"kind": "purchase", "tags": [1]}'))
            .when(e == "error", F.lit('{"k": 1.5, "kind": "error", "tags": [1, 2.5], "more": 1}'))
            .when(e == "signup", F.concat(F.lit('{"k": '), k, F.lit(', "kind": "signup", "tags": {}}')))
            .otherwise(F.concat(F.lit('{"k": '), k, F.lit(', "kind": "view", "tags": [0, true]}'))))
    return p.schema_check(table(spark, sf, "events").select("event_id", body.alias("json")), ["event_id"], "json", SCHEMA)


@query("fill_defaults", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, '[{"string":' || l_partkey % 6 || ',"fret":"' || l_suppkey % 24 || '","step":"","alter":0,"octave":0,"drum":"","marks":"' || CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag END || '"}]' AS notes FROM lineitem""")
def _(spark, sf):
    note = F.array(F.struct((F.col("l_partkey") % 6).cast("int").alias("string"), (F.col("l_suppkey") % 24).cast("string").alias("fret"), F.lit("x").alias("step"),
                            F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("marks")))
    d = table(spark, sf, "lineitem").withColumn("notes", p.compact(note, "bass"))
    return d.select("l_orderkey", *LINE_ORDER, F.to_json(p.fill_defaults(F.col("notes"), p.NOTE_FIELDS["bass"])).alias("notes"))


@query("lift_marks", """WITH e AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'A tempo quarter=' || (CAST(floor(value) AS INTEGER) % 90 + 60) WHEN 'click' THEN 'C ♩=144' WHEN 'signup' THEN 'B' WHEN 'purchase' THEN 'A tempo' ELSE 'cresc.' END AS m, event_type AS e, CAST(floor(value) AS INTEGER) % 90 + 60 AS b, CAST(floor(value) AS INTEGER) % 3 AS o FROM events)
SELECT event_id, CASE e WHEN 'view' THEN b WHEN 'click' THEN 144 ELSE 0 END AS tempo_bpm, CASE WHEN o <> 0 THEN '' ELSE CASE e WHEN 'view' THEN 'A' WHEN 'click' THEN 'C' WHEN 'signup' THEN 'B' ELSE '' END END AS rehearsal,
 CASE WHEN e IN ('view', 'click', 'signup') THEN CASE WHEN o = 0 THEN '' ELSE CASE e WHEN 'view' THEN 'A' WHEN 'click' THEN 'C' ELSE 'B' END END ELSE m END AS marks FROM e""")
def _(spark, sf):
    v = F.floor("value").cast("int")
    m = (F.when(F.col("event_type") == "view", F.concat(F.lit("A tempo quarter="), (v % 90 + 60).cast("string"))).when(F.col("event_type") == "click", "C ♩=144")
         .when(F.col("event_type") == "signup", "B").when(F.col("event_type") == "purchase", "A tempo").otherwise("cresc."))
    d = table(spark, sf, "events").select("event_id", F.array(F.struct((v % 3).alias("onset"), m.alias("marks"))).alias("events"))
    out = d.select("event_id", p.lift_marks(F.col("events"), F.lit(0), F.lit("")).alias("r"))
    return out.select("event_id", "r.tempo_bpm", "r.rehearsal", F.col("r.marks")[0].alias("marks"))


@query("mark_set_check", r"""WITH w AS (SELECT doc_id, list_sort(list_distinct(list_filter(regexp_split_to_array(text, '[ \t\n\v\f\r]+'), lambda x: x <> '' AND x NOT IN ('the', 'of', 'and', 'la', 'le', 'de')))) AS ws FROM documents)
SELECT doc_id, md5(array_to_string(ws, ', ')) AS unsupported FROM w""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(p.mark_set_check(F.col("text"), ["the", "of", "and", "la", "le", "de"])).alias("unsupported"))


@query("mode_routing", """SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN 'ai' WHEN coalesce(h, false) THEN 'manual' ELSE 'automatic' END AS mode FROM orders LEFT JOIN (SELECT l_orderkey, bool_and(CAST(l_quantity AS INTEGER) % 2 = 0) AS h FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def _(spark, sf):
    l = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_quantity").cast("int") % 2).alias("view"))
    return p.mode_routing(table(spark, sf, "orders"), l, ["o_orderkey"], F.startswith(F.col("o_orderpriority"), F.lit("1")), "view")


@query("whole_rest", """WITH b AS (SELECT l_orderkey, l_linenumber, min(l_tax) = 0 AS pickup, max(l_discount) AS d, bool_and(l_returnflag = 'N') AS silent, min(l_partkey) % 17 = 0 AS bad, count(DISTINCT l_suppkey % 2) AS voices, sum(CAST(l_quantity AS INTEGER)) AS q FROM lineitem GROUP BY ALL)
SELECT l_orderkey, l_linenumber, NOT pickup AND silent AND NOT bad AND voices = 1 AND q = 40 AS is_rest FROM b""")
def _(spark, sf):
    by = ["l_orderkey", "l_linenumber"]
    b, e, deal = bars(spark, sf)
    b = b.withColumn("issues", F.array().cast("array<string>"))
    return p.whole_rest(b, e, r.bar_issues(b, e, by, "bass", deal=deal), by, "pickup", r.LOW_CONFIDENCE)
