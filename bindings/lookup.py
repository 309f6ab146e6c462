"""Lookup, source and band queries."""

from pyspark.sql import functions as F

from bindings import query, table
from bindings.streams import EV, EVN, ev
from bindings.sequence import RAST, rasters
from obsflow.operators import bands as b
from obsflow.operators import lookup as j
from obsflow.plans.ordered import dealt
from obsflow.sources import grids as g

KEY, ORD = ["user_id"], ["t", "event_id"]
MONTH = 1704067200.0


def month(spark, sf):
    return ev(spark, sf).withColumn("t", F.col("t") - MONTH)


MEV = "mev AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 - 1704067200.0 AS t, event_type, value FROM events)"


@query("sample_grid", "WITH " + MEV + """, d AS (SELECT user_id, max(t) AS d FROM mev GROUP BY 1),
gr AS (SELECT user_id, k, k * 43200.0 AS grid_t FROM d, LATERAL (SELECT unnest(range(0, CAST(ceil(d / 43200) AS BIGINT) + 1)) AS k) WHERE k * 43200.0 < d)
SELECT gr.user_id, k, CAST(grid_t AS DOUBLE) AS grid_t, m.event_id, m.t, m.value FROM gr ASOF LEFT JOIN mev m ON gr.user_id = m.user_id AND gr.grid_t >= m.t""")
def _(spark, sf):
    d = month(spark, sf).select("user_id", "event_id", "t", "value")
    return g.sample_grid(d, KEY, ORD, "t", 43200.0)


@query("stream_metadata", """SELECT user_id, max(CAST(floor(value) AS INTEGER)) AS width, max(CAST(floor(value / 480) AS INTEGER)) AS height,
 count(*) / 2.0 AS duration FROM events GROUP BY user_id HAVING max(floor(value)) > 0 AND max(floor(value / 480)) > 0""")
def _(spark, sf):
    d = table(spark, sf, "events").select("user_id", "value")
    return g.stream_metadata(d, KEY, F.floor("value").cast("int"), F.floor(F.col("value") / 480).cast("int"), F.lit(2.0))


DUR = "du AS (SELECT user_id, (max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6 AS duration FROM events GROUP BY user_id)"


def durations(spark, sf):
    # Microseconds are subtracted as integers so that both engines divide the same number.
    from obsflow.functions.exprs import micros
    m = micros("ts")
    return table(spark, sf, "events").groupBy("user_id").agg(((F.max(m) - F.min(m)) / F.lit(1e6)).alias("duration"))


@query("overview_times", "WITH " + DUR + """ SELECT DISTINCT user_id, unnest([least(0.2, duration / 2), least(3.0, duration / 2), duration * 0.25, duration * 0.5,
 duration * 0.75, greatest(0.0, duration - 3), greatest(0.0, duration - 0.2)]) AS t FROM du""")
def _(spark, sf):
    return g.overview_times(durations(spark, sf), "duration").select("user_id", "t")


@query("tail_anchored_grid", "WITH " + DUR + """ SELECT user_id, k, k * 3600.0::DOUBLE AS t FROM du, LATERAL (SELECT unnest(range(0, CAST(ceil(duration / 3600) AS BIGINT) + 1)) AS k)
 WHERE k * 3600.0 < duration - 0.2
UNION ALL SELECT user_id, CAST(greatest(ceil((duration - 0.2) / 3600), 0) AS BIGINT), greatest(0.0, duration - 0.2) FROM du""")
def _(spark, sf):
    return g.tail_anchored_grid(durations(spark, sf), "duration", 3600.0).select("user_id", "k", "t")


@query("corpus_report", """SELECT o_orderkey AS project, count(*) AS n_lines, count(DISTINCT (l_linenumber // 3)) AS n_pages,
 count(*) FILTER (WHERE l_returnflag = 'R') AS n_warnings FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def _(spark, sf):
    l = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "project")
    l = l.join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("project")), "project", "left_semi")
    pages = l.select("project", F.floor(F.col("l_linenumber") / 3).alias("p")).distinct()
    return g.corpus_report(l, pages, l.filter("l_returnflag = 'R'"), ["project"])


@query("asof_before", "WITH " + EV + """ SELECT l.user_id, l.event_id, r.t AS before_t, r.value AS before_value
 FROM (SELECT * FROM ev WHERE event_type <> 'purchase') l ASOF LEFT JOIN (SELECT * FROM ev WHERE event_type = 'purchase') r ON l.user_id = r.user_id AND l.t > r.t""")
def _(spark, sf):
    e = ev(spark, sf).select("user_id", "event_id", "t", "value", "event_type")
    out = j.asof_lookup(e.filter("event_type <> 'purchase'"), e.filter("event_type = 'purchase'"), KEY, "t", ["event_id"], ["t", "value"])
    return out.select("user_id", "event_id", "before_t", "before_value")


@query("asof_after", "WITH " + EV + """ SELECT l.user_id, l.event_id, r.t AS after_t, r.value AS after_value
 FROM (SELECT * FROM ev WHERE event_type <> 'purchase') l ASOF LEFT JOIN (SELECT * FROM ev WHERE event_type = 'purchase') r ON l.user_id = r.user_id AND l.t < r.t""")
def _(spark, sf):
    e = ev(spark, sf).select("user_id", "event_id", "t", "value", "event_type")
    out = j.asof_lookup(e.filter("event_type <> 'purchase'"), e.filter("event_type = 'purchase'"), KEY, "t", ["event_id"], ["t", "value"], "after")
    return out.select("user_id", "event_id", "after_t", "after_value")


@query("referential_gaps", "SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def _(spark, sf):
    ref = table(spark, sf, "part").filter("p_size > 10").select(F.col("p_partkey").alias("l_partkey"))
    return j.referential_gaps(table(spark, sf, "lineitem"), ref, ["l_partkey"])


def cached(spark, sf):
    d = table(spark, sf, "documents").withColumn("digest", F.sha2("text", 256)).select("doc_id", "digest")
    done = table(spark, sf, "labels").select("doc_id").distinct()
    return d.join(done, "doc_id", "left_anti"), d.join(done, "doc_id", "left_semi")


DONE = "WITH d AS (SELECT doc_id, sha256(text) AS digest, doc_id IN (SELECT doc_id FROM labels) AS done FROM documents) SELECT doc_id, digest FROM d WHERE NOT done AND digest {} (SELECT digest FROM d WHERE done)"


@query("cache_hits", DONE.format("IN"))
def _(spark, sf):
    return j.cache_hits(*cached(spark, sf), "digest").select("doc_id", "digest")


@query("cache_misses", DONE.format("NOT IN"))
def _(spark, sf):
    return j.cache_misses(*cached(spark, sf), "digest").select("doc_id", "digest")


RATES = [("user", 0.10, 0.01, 0.50), ("assistant", 2.0, 0.2, 8.0)]
RATE_SQL = "rt(role, r_in, r_cached, r_out) AS (VALUES ('user', 0.10::DOUBLE, 0.01::DOUBLE, 0.50::DOUBLE), ('assistant', 2.0, 0.2, 8.0))"


def rates(spark):
    return spark.createDataFrame(RATES, "role string, r_in double, r_cached double, r_out double")


@query("rate_lookup", "WITH " + RATE_SQL + """ SELECT conv_id, turn, role, r_in, r_cached, r_out,
 CASE WHEN r_in IS NULL THEN 'unknown model ' || role END AS error FROM conversations LEFT JOIN rt USING (role)""")
def _(spark, sf):
    d = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    return j.rate_lookup(d, rates(spark), "role")


@query("override_lookup", """WITH i AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem),
o AS (SELECT substr(sha256('{"a":' || a || ',"b":' || b || '}'), 1, 24) AS anchor, CAST(1 + a % 16 AS INTEGER) AS target FROM i WHERE b IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000))
SELECT a, b, anchor, target FROM (SELECT a, b, substr(sha256('{"a":' || a || ',"b":' || b || '}'), 1, 24) AS anchor FROM i) LEFT JOIN o USING (anchor)""")
def _(spark, sf):
    i = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).distinct()
    good = table(spark, sf, "supplier").filter("s_acctbal > 5000").select(F.col("s_suppkey").alias("b"))
    o = i.join(good, "b", "left_semi").select(
        F.substring(F.sha2(F.to_json(F.struct("a", "b")), 256), 1, 24).alias("anchor"), (F.lit(1) + F.col("a") % 16).cast("int").alias("target"))
    return j.override_lookup(i, o, ["a", "b"])


@query("best_variant", """SELECT p_brand, p_partkey, p_size FROM part WHERE p_size >= 20 AND (p_type <> 'STANDARD' OR p_retailprice > 950)
 QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) = 1""")
def _(spark, sf):
    p = table(spark, sf, "part").withColumn("audio", F.col("p_retailprice") > 950)
    out = j.best_variant(p, ["p_brand"], ["p_retailprice", "p_partkey"], "p_size", "audio", F.lit(20), F.col("p_type") == "STANDARD")
    return out.select("p_brand", "p_partkey", "p_size")


@query("runs", """WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber AS i FROM lineitem),
s AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY l_orderkey ORDER BY i) = 1 THEN 0 ELSE 1 END AS nw FROM d),
r AS (SELECT *, sum(nw) OVER (PARTITION BY l_orderkey ORDER BY i) AS g FROM s)
SELECT l_orderkey, CAST(min(i) AS BIGINT) AS first, CAST(max(i) AS BIGINT) AS last, count(*) AS n FROM r GROUP BY l_orderkey, g""")
def _(spark, sf):
    return b.runs(table(spark, sf, "lineitem"), ["l_orderkey"], "l_linenumber")


@query("profile", "WITH " + RAST + """ SELECT vec_id, CAST((i - 1) // 8 AS INTEGER) AS i, avg(CASE WHEN raster[i] < 120 THEN 1 ELSE 0 END) AS share
 FROM ra, generate_series(1, 64) g(i) GROUP BY vec_id, (i - 1) // 8""")
def _(spark, sf):
    return b.profile(rasters(spark, sf), ["vec_id"], "raster", 8, "row", lambda v: v < 120)


@query("merge_close_last", "WITH " + EV + """ SELECT user_id, t FROM (SELECT user_id, t, lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS nx FROM ev) WHERE nx IS NULL OR nx - t >= 14400""")
def _(spark, sf):
    return b.merge_close(ev(spark, sf), KEY, ORD, "t", 14400.0)


@query("merge_close_first", "WITH RECURSIVE " + EVN + """, f AS (SELECT user_id, rn, t AS k FROM evn WHERE rn = 1
 UNION ALL SELECT s.user_id, s.rn, CASE WHEN s.t - f.k >= 14400 THEN s.t ELSE f.k END FROM f JOIN evn s ON s.user_id = f.user_id AND s.rn = f.rn + 1)
SELECT DISTINCT user_id, k AS x FROM f""")
def _(spark, sf):
    return b.merge_close(ev(spark, sf), KEY, ORD, "t", 14400.0, keep="first")


@query("regular_grids", """WITH RECURSIVE e AS (SELECT DISTINCT user_id, CAST(floor(epoch_us(ts) / 3600e6) AS DOUBLE) AS x FROM events),
d AS (SELECT user_id, x, row_number() OVER (PARTITION BY user_id ORDER BY x) AS k FROM e),
c AS (SELECT a.user_id, a.k, b.k AS kb, a.x AS x0, b.x AS x3, (b.x - a.x) / 3 AS s FROM d a JOIN d b ON a.user_id = b.user_id AND b.k >= a.k + 3 AND (b.x - a.x) / 3 BETWEEN 3 AND 35),
o AS (SELECT c.user_id, c.k, kb, x0, x3, s FROM c JOIN d y ON y.user_id = c.user_id AND y.x BETWEEN x0 AND x3 JOIN range(1, 3) r(n) ON abs(y.x - (x0 + n * s)) <= greatest(1.5, s * 0.12) GROUP BY ALL HAVING count(DISTINCT n) = 2),
m AS (SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM d y WHERE y.user_id = o.user_id AND (abs(y.x - (x0 - s)) <= greatest(1.5, s * 0.12) OR abs(y.x - (x3 + s)) <= greatest(1.5, s * 0.12)))
 QUALIFY row_number() OVER (PARTITION BY user_id, k ORDER BY x3) = 1),
g AS (SELECT d.user_id, d.k, kb, x0, x3, s FROM d LEFT JOIN m USING (user_id, k) WHERE d.k = 1
 UNION ALL SELECT d.user_id, d.k, m.kb, m.x0, m.x3, m.s FROM g JOIN d ON d.user_id = g.user_id AND d.k = coalesce(g.kb, g.k) + 1 LEFT JOIN m ON m.user_id = d.user_id AND m.k = d.k)
SELECT user_id, x0 AS first, x3 AS last, s AS spacing FROM g WHERE kb IS NOT NULL""")
def _(spark, sf):
    d = ev(spark, sf).select("user_id", F.floor(F.col("t") / 3600).alias("x")).distinct()
    return b.regular_grids(d, KEY, "x", 4)


@query("equal_spaced_groups", """WITH RECURSIVE d AS (SELECT DISTINCT user_id, CAST(epoch_us(ts) // 86400000000 AS DOUBLE) AS x FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY x) AS rn, lead(x, 1) OVER w AS x1, lead(x, 2) OVER w AS x2, lead(x, 3) OVER w AS x3, lead(x, 4) OVER w AS x4 FROM d WINDOW w AS (PARTITION BY user_id ORDER BY x)),
m AS (SELECT *, list_median([x1 - x, x2 - x1, x3 - x2, x4 - x3]) AS md FROM n),
c AS (SELECT *, coalesce(x4 IS NOT NULL AND md >= 1 AND md <= 35 AND list_max(list_transform([x1 - x, x2 - x1, x3 - x2, x4 - x3], lambda g: abs(g - md))) <= greatest(0.5, md * 0.22), false) AS ok FROM m),
f AS (SELECT user_id, 1 AS rn, ok, x, x4, md FROM c WHERE rn = 1
 UNION ALL SELECT c.user_id, c.rn, c.ok, c.x, c.x4, c.md FROM f JOIN c ON c.user_id = f.user_id AND c.rn = f.rn + CASE WHEN f.ok THEN 5 ELSE 1 END)
SELECT user_id, x AS first, x4 AS last, md AS spacing FROM f WHERE ok""".replace("list_median(", "list_aggregate(").replace("x4 - x3]) AS md", "x4 - x3], 'median') AS md"))
def _(spark, sf):
    from obsflow.functions.exprs import micros
    d = table(spark, sf, "events").select("user_id", F.floor(micros("ts") / 86400000000).cast("double").alias("x")).distinct()
    return b.equal_spaced_groups(d, KEY, "x", tol=0.5, lo=1.0)


@query("two_pass_union", "WITH " + EV + """, lo AS (SELECT user_id, t, event_id FROM ev WHERE value > 300), st AS (SELECT user_id, t, event_id FROM ev WHERE value > 200)
SELECT * FROM lo UNION ALL SELECT * FROM st WHERE NOT EXISTS (SELECT 1 FROM lo WHERE lo.user_id = st.user_id AND abs(lo.t - st.t) < 7200)""")
def _(spark, sf):
    e = ev(spark, sf).select("user_id", "t", "event_id", "value", F.lit(3600.0).alias("spacing"))
    out = b.two_pass_union(e.filter("value > 300"), e.filter("value > 200"), KEY, "t", "spacing", ["event_id"])
    return out.select("user_id", "t", "event_id")


@query("nearest_band_assign", """WITH bd AS (SELECT DISTINCT p_brand, p_size AS band, p_size * 1000.0::DOUBLE AS f, p_size * 1000.0 + 4 * (50.0 + 10 * (p_size % 5)) AS z, 50.0 + 10 * (p_size % 5) AS s FROM part),
bx AS (SELECT p_brand, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice / 2 AS y0, l_extendedprice / 2 + l_quantity * 10 AS y1 FROM lineitem JOIN part ON l_partkey = p_partkey),
c AS (SELECT bx.*, band, CASE WHEN y1 < f THEN (f - y1) / s WHEN y0 > z THEN (y0 - z) * 2.5 / s ELSE greatest(y0, f) - least(y1, z) END AS cost FROM bx JOIN bd USING (p_brand))
SELECT p_brand, l_orderkey, l_linenumber, l_partkey, l_suppkey, band, cost FROM c WHERE cost <= 9
 QUALIFY row_number() OVER (PARTITION BY p_brand, l_orderkey, l_linenumber, l_partkey, l_suppkey ORDER BY cost, band) = 1""")
def _(spark, sf):
    p = table(spark, sf, "part")
    s = F.lit(50.0) + F.col("p_size") % 5 * 10
    bands = p.select("p_brand", F.col("p_size").alias("band"), (F.col("p_size") * 1000.0).alias("f"),
                     (F.col("p_size") * 1000.0 + s * 4).alias("z"), s.alias("s")).distinct()
    boxes = table(spark, sf, "lineitem").join(p.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    boxes = boxes.select("p_brand", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_extendedprice") / 2).alias("y0"),
                         (F.col("l_extendedprice") / 2 + F.col("l_quantity") * 10).alias("y1"))
    out = b.nearest_band_assign(boxes, bands, ["p_brand"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], "y0", "y1", "band", "f", "z", "s", 1000.0)
    return out


@query("pair_bands", "WITH " + EV + """, lo AS (SELECT user_id, t, event_id FROM ev WHERE event_type = 'purchase'), up AS (SELECT user_id, t, event_id FROM ev WHERE event_type = 'view'),
c AS (SELECT lo.user_id, lo.t, max(up.t) AS u FROM lo JOIN up ON lo.user_id = up.user_id AND up.t + 600 < lo.t AND lo.t - up.t - 600 < 57600 GROUP BY ALL),
k AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM lo WHERE lo.user_id = c.user_id AND lo.t > c.u + 600 AND lo.t < c.t))
SELECT lo.user_id, coalesce(k.u, lo.t) AS first, lo.t + 600 AS last, k.u IS NOT NULL AS paired FROM lo LEFT JOIN k ON lo.user_id = k.user_id AND lo.t = k.t""")
def _(spark, sf):
    e = ev(spark, sf).select("user_id", F.col("t").alias("first"), (F.col("t") + 600).alias("last"), F.lit(3600.0).alias("spacing"), "event_type")
    out = b.pair_bands(e.filter("event_type = 'purchase'"), e.filter("event_type = 'view'"), KEY, "first", "last", "spacing")
    return out.drop("spacing")


@query("band_bounds", """WITH h AS (SELECT event_type, CAST(floor(epoch_us(ts) / 3600e6) AS BIGINT) AS h FROM events), z AS (SELECT min(h) AS a, max(h) - min(h) + 1 AS height FROM h),
p AS (SELECT event_type, CAST(h - (SELECT a FROM z) AS INTEGER) AS i, count(*) AS n FROM h GROUP BY ALL),
a AS (SELECT * FROM (SELECT *, max(n) OVER (PARTITION BY event_type) AS mx FROM p) WHERE n >= greatest(3, mx * 0.06)),
s AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY event_type ORDER BY i) <= 3 THEN 0 ELSE 1 END AS nw FROM a),
g AS (SELECT *, sum(nw) OVER (PARTITION BY event_type ORDER BY i) AS g FROM s),
b AS (SELECT event_type, min(i) AS f, max(i) AS l FROM g GROUP BY event_type, g HAVING max(i) - min(i) + 1 >= 6),
w AS (SELECT *, lag(l) OVER (PARTITION BY event_type ORDER BY f) AS pl, lead(f) OVER (PARTITION BY event_type ORDER BY f) AS nf, greatest(4, round_even((l - f + 1) * 0.3, 0)) AS pad FROM b)
SELECT event_type, CAST(greatest(0, f - pad, coalesce((pl + f) // 2 + 1, 0)) AS INTEGER) AS top, CAST(least(height, l + pad + 1, coalesce((l + nf) // 2 + 1, height)) AS INTEGER) AS bottom FROM w, z""")
def _(spark, sf):
    h = ev(spark, sf).select("event_type", F.floor(F.col("t") / 3600).alias("h"))
    first, last = h.agg(F.min("h"), F.max("h")).first()
    p = h.groupBy("event_type", (F.col("h") - (first or 0)).cast("int").alias("i")).agg(F.count(F.lit(1)).alias("n"))
    return b.band_bounds(p, ["event_type"], "i", "n", (last or 0) - (first or 0) + 1)


XS = "xs AS (SELECT DISTINCT l_orderkey, l_linestatus, CAST(floor(l_extendedprice / 100) AS INTEGER) AS x FROM lineitem)"


@query("partition_cuts", "WITH " + XS + """, d AS (SELECT DISTINCT l_orderkey, x FROM xs),
m AS (SELECT *, min(x) OVER w AS f, max(x) OVER w AS l FROM d WINDOW w AS (PARTITION BY l_orderkey)),
k AS (SELECT l_orderkey, list(x ORDER BY x) FILTER (WHERE (x > f OR f > 120) AND x < 1035) AS ks, any_value(f) <= 120 AS st, any_value(l) >= 1035 AS en FROM m GROUP BY l_orderkey),
c AS (SELECT l_orderkey, st, en, list_concat(list_concat([0], coalesce(ks, [])), [1050]) AS cs FROM k),
e AS (SELECT *, (len(cs) = 2 AND NOT (st AND en)) OR list_min(list_transform(range(2, len(cs) + 1), lambda q: cs[q] - cs[q - 1])) < 40 AS declined FROM c)
SELECT l_orderkey, CAST(NULL AS DOUBLE) AS "left", CAST(NULL AS DOUBLE) AS "right", declined FROM e WHERE declined
UNION ALL SELECT l_orderkey, CAST(cs[q - 1] AS DOUBLE), CAST(cs[q] AS DOUBLE), declined FROM e, LATERAL (SELECT unnest(range(2, len(cs) + 1)) AS q) WHERE NOT declined""")
def _(spark, sf):
    d = table(spark, sf, "lineitem").select("l_orderkey", F.floor(F.col("l_extendedprice") / 100).cast("int").alias("x"))
    return b.partition_cuts(d, ["l_orderkey"], "x", 1050.0, 20.0)


@query("complete_unit_count", "WITH " + XS + """, g AS (SELECT *, x - lag(x) OVER (PARTITION BY l_orderkey, l_linestatus ORDER BY x) AS gap FROM xs),
c AS (SELECT l_orderkey, l_linestatus, CASE WHEN count(*) >= 2 AND min(x) <= 225 AND min(gap) >= 40 THEN count(*) - 1 END AS u FROM g GROUP BY ALL)
SELECT l_orderkey, CASE WHEN count(u) = count(*) AND min(u) = max(u) THEN min(u) END AS units FROM c GROUP BY l_orderkey""")
def _(spark, sf):
    d = table(spark, sf, "lineitem").select("l_orderkey", "l_linestatus", F.floor(F.col("l_extendedprice") / 100).cast("int").alias("x"))
    d, deal = dealt(d, ["l_orderkey"])
    return b.complete_unit_count(d.distinct(), ["l_orderkey"], "l_linestatus", "x", 1500.0, 20.0, deal=deal)


@query("choose_region", """WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS pos FROM events GROUP BY ALL)
SELECT user_id, event_type, n, pos FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, pos) = 1""")
def _(spark, sf):
    c = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("pos"))
    return b.choose_region(c, KEY, "n", "pos")


@query("range_assign", "WITH " + EV + """ SELECT l.user_id, l.event_id, r.event_id AS near, abs(l.t - r.t) AS cost FROM ev l JOIN ev r ON l.user_id = r.user_id AND r.event_type = 'purchase' AND abs(l.t - r.t) <= 36000
 WHERE l.event_type <> 'purchase' QUALIFY row_number() OVER (PARTITION BY l.event_id ORDER BY abs(l.t - r.t), r.event_id) = 1""")
def _(spark, sf):
    e = ev(spark, sf)
    l = e.filter("event_type <> 'purchase'").select("user_id", "event_id", F.col("t").alias("a"))
    r = e.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("near"), F.col("t").alias("b"))
    reach = (F.col("a"), F.col("a"), F.col("b") - 36000, F.col("b") + 36000)
    return j.range_assign(l, r, KEY, ["event_id"], reach, 72000.0, F.abs(F.col("a") - F.col("b")), ["near"], 36000.0)


@query("explode_windows", """WITH d AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT source, doc_id, b AS batch, i - b * 4 AS pos FROM d, LATERAL (SELECT unnest(range(0, n)) AS b) WHERE i >= b * 4 AND i < b * 4 + 6 AND (b = 0 OR (b - 1) * 4 + 6 < n)""")
def _(spark, sf):
    from obsflow.functions import tables
    from obsflow.plans.ordered import Ordered, count_all, row_number
    tables.register(spark)
    o = Ordered(table(spark, sf, "documents").select("source", "doc_id"), ["source"], ["doc_id"]).with_columns(i=row_number(), n=count_all())
    o.result.createOrReplaceTempView("numbered_documents")
    return spark.sql("SELECT source, doc_id, w.batch, w.pos FROM numbered_documents, LATERAL explode_windows(i - 1, n, 6, 2) w")
