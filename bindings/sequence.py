"""Segmentation, deduplication and overlap queries."""

from pyspark.sql import functions as F

from bindings import query, table
from bindings.streams import EVN, ev, pages_of, pages_sql
from obsflow.functions.exprs import joined
from obsflow.operators import sequence as q
from obsflow.plans.ordered import Ordered, lag, row_number

KEY, ORD = ["user_id"], ["t", "event_id"]

VIEWS = "WITH RECURSIVE " + EVN + """, s AS (SELECT user_id, rn, t, CASE WHEN event_type <> 'error' THEN value END AS sig FROM evn),
f AS (SELECT user_id, rn, t, sig AS anchor, CASE WHEN sig IS NULL THEN 0 ELSE 1 END AS v FROM s WHERE rn = 1
 UNION ALL
 SELECT s.user_id, s.rn, s.t,
  CASE WHEN f.anchor IS NOT NULL AND s.sig IS NOT NULL AND abs(f.anchor - s.sig) <= 40 THEN f.anchor ELSE s.sig END,
  CASE WHEN f.anchor IS NOT NULL AND s.sig IS NOT NULL AND abs(f.anchor - s.sig) <= 40 THEN f.v
       WHEN s.sig IS NOT NULL THEN f.v + 1 ELSE f.v END
 FROM f JOIN s ON s.user_id = f.user_id AND s.rn = f.rn + 1),
views AS (SELECT user_id, CAST(v AS BIGINT) AS view, min(t) AS t0, max(t) + 3600 AS until, count(*) AS count
 FROM f WHERE anchor IS NOT NULL GROUP BY ALL)
"""


def views(spark, sf):
    d = ev(spark, sf).withColumn("sig", F.when(F.col("event_type") != "error", F.col("value")))
    return q.stable_views(d, KEY, ORD, "t", "sig", 40.0, 3600.0).drop("anchor")


@query("stable_views", VIEWS + "SELECT * FROM views")
def _(spark, sf):
    return views(spark, sf)


@query("stable_views_drift", "WITH RECURSIVE " + EVN + """,
f AS (SELECT user_id, rn, t, value AS anchor, 1 AS v FROM evn WHERE rn = 1
 UNION ALL
 SELECT s.user_id, s.rn, s.t, CASE WHEN abs(f.anchor - s.value) <= 40 THEN f.anchor ELSE s.value END,
  CASE WHEN abs(f.anchor - s.value) <= 40 THEN f.v ELSE f.v + 1 END
 FROM f JOIN evn s ON s.user_id = f.user_id AND s.rn = f.rn + 1)
SELECT user_id, CAST(v AS BIGINT) AS view, min(t) AS t0, max(t) + 3600 AS until, count(*) AS count, any_value(anchor) AS anchor
FROM f GROUP BY user_id, v""")
def _(spark, sf):
    return q.stable_views(ev(spark, sf), KEY, ORD, "t", "value", 40.0, 3600.0)


@query("min_support", VIEWS + """SELECT user_id, count(*) FILTER (WHERE count >= 2) AS kept,
 count(*) FILTER (WHERE count < 2) AS rejected FROM views GROUP BY user_id""")
def _(spark, sf):
    return q.min_support(views(spark, sf), KEY)[1]


@query("view_report", VIEWS + """SELECT user_id, count(*) FILTER (WHERE count >= 2) AS kept,
 count(*) FILTER (WHERE count < 2) AS rejected,
 coalesce(max(until - t0) FILTER (WHERE count >= 2), 0) AS longest FROM views GROUP BY user_id""")
def _(spark, sf):
    return views(spark, sf).groupBy("user_id").agg(
        F.count_if(F.col("count") >= 2).alias("kept"),
        F.count_if(F.col("count") < 2).alias("rejected"),
        F.coalesce(F.max(F.when(F.col("count") >= 2, F.col("until") - F.col("t0"))), F.lit(0.0)).alias("longest"))


@query("view_sample", """SELECT user_id, event_type, event_id, pick FROM (SELECT user_id, event_type, event_id,
 CAST(row_number() OVER (PARTITION BY user_id, event_type
  ORDER BY md5(user_id || '|' || event_type || '|' || event_id), event_id) AS INTEGER) AS pick FROM events) WHERE pick <= 9""")
def _(spark, sf):
    d = table(spark, sf, "events").select("user_id", "event_type", "event_id")
    return q.view_sample(d, KEY, ["event_type"], ["event_id"]).select("user_id", "event_type", "event_id", "pick")


def rasters(spark, sf):
    e = table(spark, sf, "embeddings")
    grey = F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 127.5).cast("int"))
    return e.select("vec_id", "label", grey.alias("raster"))


RAST = "ra AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor((CAST(x AS DOUBLE) + 1) * 127.5) AS INTEGER)) AS raster FROM embeddings)"


@query("median_composite", "WITH " + RAST + """, c AS (SELECT label, i, CAST(trunc(median(raster[i])) AS INTEGER) AS m
 FROM ra, generate_series(1, 64) g(i) GROUP BY ALL)
SELECT label, string_agg(CAST(m AS VARCHAR), ',' ORDER BY i) AS raster FROM c GROUP BY label""")
def _(spark, sf):
    return q.median_composite(rasters(spark, sf), ["label"], "raster").withColumn("raster", joined(F.col("raster")))


@query("blank_reject", "WITH " + RAST + """, s AS (SELECT vec_id, len(list_filter(raster, lambda x: x < 110)) / len(raster) AS ink_share FROM ra)
SELECT vec_id, ink_share, ink_share < 0.1 AS rejected FROM s""")
def _(spark, sf):
    return q.blank_reject(rasters(spark, sf), "raster", 110, 0.1).drop("raster", "label")


TRIM = """, pv AS (SELECT *, lag(rows, 1, []) OVER (PARTITION BY {k} ORDER BY page) AS prev FROM pg),
ks AS (SELECT {k}, page, max(k) AS k FROM pv, LATERAL (SELECT unnest(range(1, least(len(prev), len(rows)) + 1)) AS k)
 WHERE prev[len(prev) - k + 1:] = rows[1:k] GROUP BY {k}, page)
SELECT pv.{k}, pv.page, CAST(coalesce(ks.k, 0) AS INTEGER) AS overlap,
 array_to_string(pv.rows[coalesce(ks.k, 0) + 1:], ',') AS rows
FROM pv LEFT JOIN ks ON pv.{k} = ks.{k} AND pv.page = ks.page"""


@query("overlap_trim", "WITH " + pages_sql(6) + TRIM.format(k="user_id"))
def _(spark, sf):
    out = q.overlap_trim(pages_of(spark, sf, 6), KEY, ["page"], "rows")
    return out.select("user_id", "page", "overlap", joined(F.col("rows")).alias("rows"))


@query("overlap_trim_text", """WITH pg AS (SELECT source, doc_id AS page, string_split(text, chr(10)) AS rows FROM documents)"""
       + TRIM.format(k="source").replace("array_to_string", "md5(array_to_string").replace("',') AS rows", "chr(10))) AS rows"))
def _(spark, sf):
    d = table(spark, sf, "documents").select("source", F.col("doc_id").alias("page"), F.split("text", "\n").alias("rows"))
    out = q.overlap_trim(d, ["source"], ["page"], "rows")
    return out.select("source", "page", "overlap", F.md5(F.array_join("rows", "\n")).alias("rows"))


@query("overlap_trim_blank", "WITH " + pages_sql(2).replace("list(event_type ORDER BY rn)",
       "CASE WHEN bool_or(event_type = 'error') THEN [] ELSE list(event_type ORDER BY rn) END") + TRIM.format(k="user_id"))
def _(spark, sf):
    d = pages_of(spark, sf, 2)
    out = q.overlap_trim(d, KEY, ["page"], "rows", blank=F.array_contains("rows", "error"))
    return out.select("user_id", "page", "overlap", joined(F.col("rows")).alias("rows"))


def _apart(a, b):
    return abs(a - b) <= 40


@query("overlap_trim_hold_anchor", "WITH RECURSIVE " + EVN + """,
pg AS (SELECT user_id, (rn - 1) // 4 * 3 + least(2, (rn - 1) % 4) AS page, list(value ORDER BY rn) AS rows FROM evn GROUP BY ALL),
f AS (SELECT user_id, page, rows AS anchor, rows, 0 AS k FROM pg WHERE page = 0
 UNION ALL
 SELECT p.user_id, p.page, CASE WHEN o.k = 1 AND len(p.rows) = 1 THEN f.anchor ELSE p.rows END, p.rows, o.k
 FROM f JOIN pg p ON p.user_id = f.user_id AND p.page = f.page + 1,
 LATERAL (SELECT CASE
   WHEN len(p.rows) = 1 THEN CASE WHEN abs(f.anchor[-1] - p.rows[1]) <= 40 THEN 1 ELSE 0 END
   WHEN len(f.anchor) = 1 THEN 0
   WHEN abs(f.anchor[1] - p.rows[1]) <= 40 AND abs(f.anchor[2] - p.rows[2]) <= 40 THEN 2
   WHEN abs(f.anchor[2] - p.rows[1]) <= 40 THEN 1 ELSE 0 END AS k) o)
SELECT user_id, page, CAST(k AS INTEGER) AS overlap, CAST(len(rows) - k AS INTEGER) AS left_rows FROM f""")
def _(spark, sf):
    o = Ordered(ev(spark, sf), KEY, ORD).with_columns(rn=row_number())
    i = F.col("rn") - 1
    page = F.floor(i / 4) * 3 + F.least(F.lit(2), i % 4)
    d = o.result.groupBy("user_id", page.alias("page")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rn", "value"))), lambda x: x["value"]).alias("rows"))
    out = q.overlap_trim(d, KEY, ["page"], "rows", multi_only=True, hold_anchor=True, same_value=_apart)
    return out.select("user_id", "page", "overlap", F.size("rows").alias("left_rows"))


@query("extend_visibility", "WITH RECURSIVE " + EVN + """,
s AS (SELECT *, coalesce(event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY rn), false) AS rep FROM evn),
f AS (SELECT user_id, rn, event_id AS seq, t + 43200 AS until FROM s WHERE rn = 1
 UNION ALL
 SELECT s.user_id, s.rn, CASE WHEN s.rep THEN f.seq ELSE s.event_id END,
  CASE WHEN NOT s.rep OR abs(f.until - s.t) <= 1.1 * 43200 THEN s.t + 43200 ELSE f.until END
 FROM f JOIN s ON s.user_id = f.user_id AND s.rn = f.rn + 1)
SELECT user_id, seq, max(until) AS visible_until FROM f GROUP BY user_id, seq""")
def _(spark, sf):
    o = Ordered(ev(spark, sf), KEY, ORD).with_columns(_p=lag("event_type"))
    d = o.result.withColumn("rep", F.coalesce(F.col("_p") == F.col("event_type"), F.lit(False))).withColumn("until", F.col("t") + 43200)
    return q.extend_visibility(d, KEY, ORD, "event_id", "t", "until", "rep", 43200.0)


@query("hold_dedup", "WITH RECURSIVE " + EVN + """,
s AS (SELECT *, coalesce(event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY rn), false) AS eq FROM evn),
f AS (SELECT user_id, rn, t AS last_t, CAST(NULL AS BIGINT) AS pend, CAST(NULL AS BIGINT) AS flushed, true AS kept FROM s WHERE rn = 1
 UNION ALL
 SELECT s.user_id, s.rn, CASE WHEN h THEN f.last_t ELSE s.t END, CASE WHEN h THEN s.rn END, CASE WHEN NOT h THEN f.pend END, NOT h
 FROM f JOIN s ON s.user_id = f.user_id AND s.rn = f.rn + 1,
 LATERAL (SELECT s.eq AND s.t - f.last_t < 86400 AND s.rn < s.n AS h) x)
SELECT user_id, event_id, t FROM evn JOIN (SELECT user_id, rn FROM f WHERE kept UNION SELECT user_id, flushed FROM f WHERE flushed IS NOT NULL) k
 USING (user_id, rn)""")
def _(spark, sf):
    d = ev(spark, sf).select("user_id", "event_id", "t", "event_type")
    return q.hold_dedup(d, KEY, ORD, "t", "event_type", 86400.0).drop("event_type")


@query("join_overlapping_panels", "WITH " + pages_sql(12) + """,
pn AS (SELECT user_id, page, rows, list_filter(range(0, len(rows)), lambda i: rows[i + 1] = 'purchase') AS b FROM pg),
pv AS (SELECT *, lag(rows) OVER (PARTITION BY user_id ORDER BY page) AS pr, lag(b) OVER (PARTITION BY user_id ORDER BY page) AS pb FROM pn),
sh AS (SELECT user_id, page, d, count(*) FILTER (WHERE pr[i + d + 2] <> rows[i + 2]) / count(*) AS e
 FROM pv, range(1, 12) x(d), range(0, 12) y(i)
 WHERE pr IS NOT NULL AND len(rows) = len(pr) AND d > len(pr) * .07 AND d < len(pr) * .96 AND i < len(pr) - d - 2 GROUP BY user_id, page, d),
bs AS (SELECT user_id, page, d FROM sh WHERE e <= .035 QUALIFY row_number() OVER (PARTITION BY user_id, page ORDER BY e, d) = 1),
ct AS (SELECT user_id, page, max(x) AS cut_left, max(x - d) AS cut_right
 FROM pv JOIN bs USING (user_id, page), LATERAL (SELECT unnest(pb) AS x) WHERE list_contains(b, x - d) GROUP BY ALL)
SELECT user_id, page, CAST(d AS INTEGER) AS shift, CAST(cut_left AS INTEGER) AS cut_left, CAST(cut_right AS INTEGER) AS cut_right,
 cut_left IS NOT NULL AS joined
FROM pv LEFT JOIN bs USING (user_id, page) LEFT JOIN ct USING (user_id, page)""")
def _(spark, sf):
    b = F.filter(F.transform("rows", lambda x, i: F.when(x == "purchase", i)), lambda i: i.isNotNull())
    d = pages_of(spark, sf, 12).withColumn("b", b)
    return q.join_overlapping_panels(d, KEY, ["page"], "rows", "b").drop("rows", "b")


@query("snap_region", "WITH RECURSIVE " + EVN + """,
s AS (SELECT user_id, event_id, rn, CAST(floor(value / 20) AS INTEGER) AS x, CAST(floor(value / 40) AS INTEGER) AS y FROM evn),
f AS (SELECT user_id, event_id, rn, x AS ax, y AS ay FROM s WHERE rn = 1
 UNION ALL
 SELECT s.user_id, s.event_id, s.rn, CASE WHEN abs(ax - x) <= 3 AND abs(ay - y) <= 3 THEN ax ELSE x END,
  CASE WHEN abs(ax - x) <= 3 AND abs(ay - y) <= 3 THEN ay ELSE y END
 FROM f JOIN s ON s.user_id = f.user_id AND s.rn = f.rn + 1)
SELECT user_id, event_id, ax || ',' || ay AS box FROM f""")
def _(spark, sf):
    d = ev(spark, sf).select("user_id", "event_id", "t", F.array(
        F.floor(F.col("value") / 20).cast("int"), F.floor(F.col("value") / 40).cast("int")).alias("box"))
    return q.snap_region(d, KEY, ORD, "box").select("user_id", "event_id", joined(F.col("box")).alias("box"))


@query("wander_test", """SELECT user_id, event_type, count(*) AS n, max(value) - min(value) AS spread,
 count(*) >= 3 AND max(value) - min(value) > 300 AS moves FROM events GROUP BY ALL""")
def _(spark, sf):
    return q.wander_test(table(spark, sf, "events"), ["user_id", "event_type"], "value", F.lit(20000.0))


@query("change_decimate", "WITH RECURSIVE " + EVN + """,
p AS (SELECT *, CASE WHEN event_type = 'click' THEN 1 ELSE 2 END AS len, CAST(floor(value / 50) AS INTEGER) AS x FROM evn),
s AS (SELECT *, coalesce(len <> lag(len) OVER w OR abs(x - lag(x) OVER w) > 2, true) AS moved FROM p WINDOW w AS (PARTITION BY user_id ORDER BY rn)),
f AS (SELECT user_id, event_id, rn, t, t AS last_t, true AS kept FROM s WHERE rn = 1
 UNION ALL
 SELECT s.user_id, s.event_id, s.rn, s.t, CASE WHEN s.moved OR s.t - f.last_t >= 43200 THEN s.t ELSE f.last_t END, s.moved OR s.t - f.last_t >= 43200
 FROM f JOIN s ON s.user_id = f.user_id AND s.rn = f.rn + 1)
SELECT user_id, event_id, t FROM f WHERE kept""")
def _(spark, sf):
    x = F.floor(F.col("value") / 50).cast("int")
    d = ev(spark, sf).select("user_id", "event_id", "t", F.when(F.col("event_type") == "click", F.array(x)).otherwise(F.array(x, x + 1)).alias("pos"))
    return q.change_decimate(d, KEY, ORD, "t", "pos", 2, 43200.0).drop("pos")


@query("count_windows", """WITH d AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i,
 count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT source, doc_id, b AS batch, i - b * 7 AS pos FROM d, LATERAL (SELECT unnest(range(0, n)) AS b)
 WHERE i >= b * 7 AND i < b * 7 + 8 AND (b = 0 OR (b - 1) * 7 + 8 < n)""")
def _(spark, sf):
    d = table(spark, sf, "documents").select("source", "doc_id")
    return q.count_windows(d, ["source"], ["doc_id"])


@query("ordered_distinct", """WITH l AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents),
f AS (SELECT source, line, min((doc_id, p)) AS k FROM l GROUP BY ALL)
SELECT source, row_number() OVER (PARTITION BY source ORDER BY k) AS pos, line FROM f""")
def _(spark, sf):
    d = table(spark, sf, "documents").select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    return q.ordered_distinct(d, ["source"], ["doc_id", "p"], "line")
