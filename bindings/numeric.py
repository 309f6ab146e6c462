"""Time-series, difference and remaining band queries."""

from pyspark.sql import functions as F

from bindings import query, table
from bindings.lookup import month
from bindings.sequence import RAST, rasters
from bindings.streams import EV, EVN, ev
from obsflow.functions.exprs import joined
from obsflow.operators import bands as b
from obsflow.operators import diff as d
from obsflow.operators import timeseries as t
from obsflow.plans.ordered import Ordered, lag, lead
from obsflow.plans.ranges import explode_range

KEY, ORD = ["user_id"], ["t", "event_id"]
TYPE = ["event_type"]


def hourly(spark, sf, minutes=60):
    """Dense event counts per type, from the first to the last interval that has events."""
    e = month(spark, sf).withColumn("i", F.floor(F.col("t") / (minutes * 60)))
    first, last = e.agg(F.min("i"), F.max("i")).first()
    first, last = (0, -1) if first is None else (first, last)
    n = e.groupBy("event_type", (F.col("i") - first).alias("i")).agg(F.count(F.lit(1)).alias("n"))
    grid = explode_range(e.select("event_type").distinct(), "i", F.lit(0), F.lit(last - first))
    return grid.join(n, ["event_type", "i"], "left").select("event_type", "i", F.coalesce("n", F.lit(0)).cast("double").alias("x"))


def dense_sql(name, minutes):
    return f"""{name}c AS (SELECT event_type, CAST(floor((epoch_us(ts) - 1704067200000000) / {minutes * 60e6}) AS BIGINT) AS h, count(*) AS n FROM events GROUP BY ALL),
{name}z AS (SELECT min(h) AS a, max(h) AS z FROM {name}c),
{name} AS (SELECT ty.event_type, g.i, CAST(coalesce(c.n, 0) AS DOUBLE) AS x FROM (SELECT DISTINCT event_type FROM events) ty, {name}z, LATERAL (SELECT unnest(range(0, z - a + 1)) AS i) g
 LEFT JOIN {name}c c ON c.event_type = ty.event_type AND c.h - (SELECT a FROM {name}z) = g.i)"""


HOURS = dense_sql("hr", 60)


def onset_sql(by):
    return f""", ri AS (SELECT {by}, i, x - lag(x) OVER (PARTITION BY {by} ORDER BY i) AS df FROM hs),
rs AS (SELECT {by}, i, greatest(0, df) AS r FROM ri WHERE df IS NOT NULL),
cl AS (SELECT {by}, i, greatest(0, r - sum(r) OVER (PARTITION BY {by} ORDER BY i ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) / 21) AS c FROM rs),
os AS (SELECT {by}, i, c - avg(c) OVER (PARTITION BY {by}) AS onset FROM cl)"""


def ac_sql(by):
    return f""", en AS (SELECT {by}, sum(onset * onset) AS e, count(*) AS n FROM os GROUP BY ALL),
pr AS (SELECT {by}, k AS lag, sum(a.onset * b.onset) AS p FROM os a JOIN os b USING ({by}), range(0, 74) g(k) WHERE b.i = a.i + k GROUP BY ALL),
ac AS (SELECT {by}, lag, p / e * n / (n - lag) AS ac FROM pr JOIN en USING ({by}))"""


def score_sql(by):
    return f""", tp AS (SELECT (600 + j) / 10 AS tempo FROM range(0, 1401) g(j)), ms AS (SELECT tempo, m, w, 1440 / tempo * m AS pt FROM tp, (VALUES (1, 1.0::DOUBLE), (2, 0.5), (3, 0.25)) v(m, w)),
cc AS (SELECT *, CAST(round_even(pt, 0) AS BIGINT) AS c, pt - round_even(pt, 0) AS dl FROM ms),
s0 AS (SELECT {", ".join("a." + c.strip() for c in by.split(","))}, tempo, sum(w * (a.ac + dl * (u.ac - l.ac) / 2 + dl * dl * (u.ac - 2 * a.ac + l.ac) / 2)) AS raw
 FROM cc JOIN ac a ON a.lag = cc.c JOIN ac u ON u.lag = cc.c + 1 AND {" AND ".join(f"u.{c.strip()} = a.{c.strip()}" for c in by.split(","))} JOIN ac l ON l.lag = cc.c - 1 AND {" AND ".join(f"l.{c.strip()} = a.{c.strip()}" for c in by.split(","))} GROUP BY ALL),
sc AS (SELECT {by}, tempo, raw * exp(-0.5 * power(ln(tempo / 120) / 0.75, 2)) AS score FROM s0)"""


ONE = "WITH " + HOURS + ", hs AS (SELECT * FROM hr)"
SEG = "WITH " + HOURS + ", hs AS (SELECT event_type, i // 240 AS seg, i, x FROM hr)"


@query("onset_strength", ONE + onset_sql("event_type") + " SELECT event_type, i, round(onset, 6) AS onset FROM os")
def _(spark, sf):
    return t.onset_strength(hourly(spark, sf), TYPE, "i", "x").withColumn("onset", F.round("onset", 6))


@query("autocorrelation", ONE + onset_sql("event_type") + ac_sql("event_type") + " SELECT event_type, CAST(lag AS INTEGER) AS lag, round(ac, 6) AS ac FROM ac")
def _(spark, sf):
    o = t.onset_strength(hourly(spark, sf), TYPE, "i", "x")
    return t.autocorrelation(o, TYPE, "i", "onset", 73).withColumn("ac", F.round("ac", 6))


@query("period_score", ONE + onset_sql("event_type") + ac_sql("event_type") + score_sql("event_type") + " SELECT event_type, tempo, round(score, 6) AS score FROM sc")
def _(spark, sf):
    o = t.onset_strength(hourly(spark, sf), TYPE, "i", "x")
    return t.period_score(t.autocorrelation(o, TYPE, "i", "onset", 73), TYPE, 1440.0).withColumn("score", F.round("score", 6))


@query("segment_consensus", SEG + onset_sql("event_type, seg") + ac_sql("event_type, seg") + score_sql("event_type, seg") + """, mn AS (SELECT event_type, tempo, avg(score) AS s FROM sc GROUP BY ALL),
tb AS (SELECT event_type, tempo AS bpm FROM mn WHERE s >= 0.02 QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY s DESC, tempo) = 1 AND s >= 0.02),
ow AS (SELECT event_type, seg, tempo FROM sc QUALIFY row_number() OVER (PARTITION BY event_type, seg ORDER BY score DESC, tempo) = 1)
SELECT event_type, bpm, bool_and(abs(tempo - bpm) / bpm < 0.04) AS consistent, round_even(bpm / 2, 1) AS half, round_even(bpm * 2, 1) AS double FROM ow JOIN tb USING (event_type) GROUP BY ALL""")
def _(spark, sf):
    by = ["event_type", "seg"]
    h = hourly(spark, sf).withColumn("seg", F.floor(F.col("i") / 240))
    s = t.period_score(t.autocorrelation(t.onset_strength(h, by, "i", "x"), by, "i", "onset", 73), by, 1440.0)
    return t.segment_consensus(s, TYPE, "seg", min_score=0.02)


@query("spectral_onset", "WITH " + dense_sql("mn", 1) + """, w AS (SELECT event_type, i // 16 AS k0, i, x FROM mn), last AS (SELECT event_type, max(i) AS z FROM mn GROUP BY 1),
fr AS (SELECT event_type, unnest(range(0, (z - 63) // 16 + 1)) AS k FROM last WHERE z >= 63),
ft AS (SELECT fr.event_type, fr.k, f, sum(x * (0.5 - 0.5 * cos(2 * pi() * (i - 16 * k) / 63)) * cos(2 * pi() * f * (i - 16 * k) / 64)) AS re, sum(x * (0.5 - 0.5 * cos(2 * pi() * (i - 16 * k) / 63)) * sin(2 * pi() * f * (i - 16 * k) / 64)) AS im
 FROM fr JOIN mn ON mn.event_type = fr.event_type AND mn.i >= 16 * k AND mn.i < 16 * k + 64, range(1, 32) q(f) GROUP BY ALL),
lg AS (SELECT event_type, k, f, ln(1 + 10 * sqrt(re * re + im * im)) AS v FROM ft),
df AS (SELECT a.event_type, a.k, greatest(0, b.v - a.v) AS r FROM lg a JOIN lg b ON b.event_type = a.event_type AND b.f = a.f AND b.k = a.k + 1)
SELECT event_type, k AS frame, round(avg(r), 6) + 0.0 AS flux FROM df GROUP BY ALL""")
def _(spark, sf):
    return t.spectral_onset(hourly(spark, sf, minutes=1), TYPE, "i", "x", size=64, hop=16, low=1, high=32).withColumn("flux", F.round("flux", 6))


TIMED = "WITH " + EV + """, q AS (SELECT user_id, event_id, event_type, floor((t - 1704067200) / 21600) * 10 AS t FROM ev),
n AS (SELECT *, row_number() OVER w AS rn, lead(t) OVER w AS nt, CASE WHEN event_type = 'click' THEN 2 ELSE 4 END AS bars FROM q WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
u AS (SELECT *, CASE WHEN event_type <> 'error' THEN nt ELSE t + 1 END AS until FROM n),
x AS (SELECT *, CASE WHEN abs(until - nt) <= 0.55 AND nt <> t THEN nt - t END AS observed, bars * 4.0 * 60 / 96 AS expected FROM u)"""


def timed_lines(spark, sf):
    x = month(spark, sf).select("user_id", "event_id", "event_type", (F.floor(F.col("t") / 21600) * 10).cast("double").alias("t"))
    o = Ordered(x, KEY, ORD).with_columns(_n=lead("t"))
    return o.result.select("user_id", "event_id", "t", F.when(F.col("event_type") != "error", F.col("_n")).otherwise(F.col("t") + 1).alias("until"),
                           F.when(F.col("event_type") == "click", 2).otherwise(4).alias("bars"))


@query("expected_duration", TIMED + " SELECT user_id, event_id, observed, CAST(expected AS DOUBLE) AS expected FROM x")
def _(spark, sf):
    out = t.expected_duration(timed_lines(spark, sf), KEY, ORD, "t", "until", "bars", 96.0, 4.0, 0.5)
    return out.select("user_id", "event_id", "observed", "expected")


@query("timed_repeats", TIMED + """, s AS (SELECT *, coalesce(abs(observed - expected) <= greatest(0.625, expected * 0.06), false) AND rn > 1 AND nt IS NOT NULL AS one FROM x),
c AS (SELECT a.user_id, a.event_id, count(*) FILTER (WHERE b.one) AS sup, count(*) FILTER (WHERE b.one AND b.rn < a.rn) AS bf, count(*) FILTER (WHERE b.one AND b.rn > a.rn) AS af FROM s a JOIN s b ON a.user_id = b.user_id AND b.rn BETWEEN a.rn - 3 AND a.rn + 3 AND b.rn <> a.rn GROUP BY ALL),
p AS (SELECT s.*, CASE WHEN rn > 1 AND nt IS NOT NULL AND ps BETWEEN 2 AND 4 AND abs(observed - ps * expected) <= greatest(0.625, expected * 0.06) AND sup >= 3 AND bf > 0 AND af > 0 THEN CAST(ps AS INTEGER) ELSE 1 END AS passes
 FROM s LEFT JOIN c USING (user_id, event_id), LATERAL (SELECT round_even(observed / expected, 0) AS ps) z)
SELECT user_id, event_id, bars, CAST(k AS INTEGER) AS copy, CASE WHEN k > 0 THEN round_even(t + observed * k / passes, 3) ELSE t END AS t, CASE WHEN passes > 1 THEN round_even(t + observed * (k + 1) / passes, 3) ELSE until END AS until
FROM p, LATERAL (SELECT unnest(range(0, passes)) AS k)""")
def _(spark, sf):
    return t.timed_repeats(timed_lines(spark, sf), KEY, ORD, "t", "until", "bars", 96.0, 4.0, 0.5)


@query("net_active_time", "WITH " + EV + """, o AS (SELECT user_id, event_id, epoch_us(ts) AS us, event_type FROM events),
s AS (SELECT *, sum(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN -1 ELSE 0 END) OVER w AS act, last_value(CASE event_type WHEN 'purchase' THEN true WHEN 'signup' THEN false END IGNORE NULLS) OVER w AS req, lead(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS nx FROM o WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)),
g AS (SELECT user_id, max(us) - min(us) AS e, coalesce(sum(nx - us) FILTER (WHERE coalesce(req, false) AND act <= 0), 0) AS p FROM s GROUP BY 1)
SELECT user_id, CAST(e - p AS BIGINT) AS active_s, CAST(p AS BIGINT) AS paused_s FROM g""")
def _(spark, sf):
    from obsflow.functions.exprs import micros
    e = table(spark, sf, "events")
    op = F.when(F.col("event_type") == "view", "begin").when(F.col("event_type") == "click", "end").when(F.col("event_type") == "purchase", "pause").when(F.col("event_type") == "signup", "resume").otherwise("note")
    log = e.select("user_id", "event_id", micros("ts").alias("us"), op.alias("op"))
    # Microseconds keep the sums exact; the operator itself works in any unit.
    out = t.net_active_time(log, KEY, ["us", "event_id"], "us", "op")
    return out.select("user_id", F.col("active_s").cast("bigint").alias("active_s"), F.col("paused_s").cast("bigint").alias("paused_s"))


@query("playback_position", "WITH RECURSIVE " + EVN + """, o AS (SELECT user_id, event_id, rn, floor((t - 1704067200) / 60) AS now, event_type AS e, floor(value) AS v FROM evn),
f AS (SELECT user_id, event_id, rn, now, CASE WHEN e = 'purchase' THEN least(20000, v * 50) ELSE 0.0::DOUBLE END AS pos, CASE WHEN e = 'signup' AND v / 100 BETWEEN 0.25 AND 2 THEN v / 100 ELSE 1.0 END AS sp, e = 'view' AS pl FROM o WHERE rn = 1
 UNION ALL SELECT o.user_id, o.event_id, o.rn, o.now, CASE WHEN e = 'purchase' THEN least(20000, greatest(0, v * 50)) WHEN e = 'view' AND cur >= 20000 THEN 0 ELSE cur END, CASE WHEN e = 'signup' AND v / 100 BETWEEN 0.25 AND 2 THEN v / 100 ELSE sp END,
  CASE WHEN e = 'view' THEN true WHEN e = 'click' THEN false ELSE pl END
 FROM f JOIN o ON o.user_id = f.user_id AND o.rn = f.rn + 1, LATERAL (SELECT least(20000, f.pos + CASE WHEN f.pl THEN (o.now - f.now) * f.sp ELSE 0 END) AS cur) z)
SELECT user_id, event_id, round(pos, 6) AS position FROM f""")
def _(spark, sf):
    op = F.when(F.col("event_type") == "view", "play").when(F.col("event_type") == "click", "pause").when(F.col("event_type") == "purchase", "seek").when(F.col("event_type") == "signup", "speed").otherwise("note")
    v = F.floor("value")
    log = month(spark, sf).select("user_id", "event_id", F.col("t").alias("at"), F.floor(F.col("t") / 60).cast("double").alias("now"), op.alias("op"),
                                  F.when(op == "seek", v * 50.0).otherwise(v / 100).alias("v"))
    out = t.playback_position(log, KEY, ["at", "event_id"], "now", "op", "v", 20000.0)
    return out.select("user_id", "event_id", F.round("position", 6).alias("position"))


@query("progress_rollup", "WITH " + EV + """, l AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY t DESC, event_id DESC) = 1)
SELECT user_id, event_type AS phase, CAST(floor(value) AS BIGINT) AS completed, 500 AS total, event_id AS saved, floor(value) / 500 AS fraction, 1706572800 - t >= 43200 AS stale FROM l""")
def _(spark, sf):
    e = ev(spark, sf).select("user_id", "event_id", "t", F.col("event_type").alias("ph"), F.floor("value").alias("c"), F.lit(500).alias("n"), F.col("event_id").alias("s"))
    return t.progress_rollup(e, KEY, "t", ["event_id"], "ph", "c", "n", "s", F.lit(1706572800.0), 43200.0)


PAIR = """, pr AS (SELECT vec_id, raster AS a, lag(raster) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM ra QUALIFY b IS NOT NULL)"""


def raster_pairs(spark, sf):
    o = Ordered(rasters(spark, sf), ["label"], ["vec_id"]).with_columns(b=lag("raster"))
    return o.where(F.col("b").isNotNull()).result.select("vec_id", F.col("raster").alias("a"), "b")


def ink_pairs(spark, sf):
    p = raster_pairs(spark, sf)
    return p.select("vec_id", d.ink_bitmap(F.col("a"), 8, 8, 125, 0).alias("a"), d.ink_bitmap(F.col("b"), 8, 8, 125, 0).alias("b"))


@query("ink_bitmap", "WITH " + RAST + """ SELECT vec_id, array_to_string(list_transform(range(0, 64), lambda i: CASE WHEN i % 8 BETWEEN 1 AND 6 AND i // 8 BETWEEN 1 AND 6 AND raster[i + 1] < 125 THEN 1 ELSE 0 END), '') AS ink FROM ra""")
def _(spark, sf):
    return rasters(spark, sf).select("vec_id", joined(d.ink_bitmap(F.col("raster"), 8, 8, 125, 1), "").alias("ink"))


CHANGED = "WITH " + RAST + PAIR + """, c AS (SELECT vec_id, i % 8 AS x, i // 8 AS y, CAST(a[i + 1] < 125 AS INTEGER) AS p, CAST(b[i + 1] < 125 AS INTEGER) AS q FROM pr, range(0, 64) g(i)),
gr AS (SELECT c.vec_id, c.x, c.y, c.p, c.q, max(n.p) AS gp, max(n.q) AS gq FROM c JOIN c n ON n.vec_id = c.vec_id AND abs(n.x - c.x) <= 1 AND abs(n.y - c.y) <= 1 GROUP BY ALL),
ch AS (SELECT *, (p = 1 AND gq = 0) OR (q = 1 AND gp = 0) AS ch FROM gr)"""


@query("tolerant_difference", CHANGED + """, bl AS (SELECT a.vec_id, a.x, a.y FROM ch a WHERE (SELECT count(*) FROM ch n WHERE n.vec_id = a.vec_id AND n.ch AND n.x - a.x IN (0, 1) AND n.y - a.y IN (0, 1)) = 4),
kp AS (SELECT DISTINCT ch.vec_id, ch.x, ch.y FROM ch JOIN bl ON bl.vec_id = ch.vec_id AND ch.x - bl.x IN (0, 1) AND ch.y - bl.y IN (0, 1)),
s AS (SELECT vec_id, sum(p + q) AS ink FROM ch GROUP BY 1)
SELECT s.vec_id, (SELECT count(*) FROM kp WHERE kp.vec_id = s.vec_id) / greatest(1, ink) AS diff FROM s""")
def _(spark, sf):
    return d.tolerant_difference(ink_pairs(spark, sf), "a", "b", 8, 8).select("vec_id", "diff")


@query("tolerant_difference_fine", CHANGED + """, nb AS (SELECT a.vec_id, a.x, a.y, (SELECT count(*) FROM ch n WHERE n.vec_id = a.vec_id AND n.ch AND abs(n.x - a.x) <= 1 AND abs(n.y - a.y) <= 1) - 1 AS k FROM ch a WHERE a.ch),
kp AS (SELECT a.vec_id, count(*) AS n FROM nb a WHERE k >= 2 OR EXISTS (SELECT 1 FROM nb n WHERE n.vec_id = a.vec_id AND n.k >= 2 AND abs(n.x - a.x) <= 1 AND abs(n.y - a.y) <= 1) GROUP BY 1),
s AS (SELECT vec_id, sum(p + q) AS ink FROM ch GROUP BY 1)
SELECT vec_id, least(1, coalesce(n, 0) / greatest(1, ink) * 2) AS diff FROM s LEFT JOIN kp USING (vec_id)""")
def _(spark, sf):
    return d.tolerant_difference(ink_pairs(spark, sf), "a", "b", 8, 8, fine=True).select("vec_id", "diff")


@query("local_window_difference", "WITH " + RAST + PAIR + """, c AS (SELECT vec_id, i, CAST(a[i + 1] < 125 AS INTEGER) AS p, CAST(b[i + 1] < 125 AS INTEGER) AS q FROM pr, range(0, 64) g(i)),
u AS (SELECT *, CASE WHEN p = 1 AND greatest(q, coalesce(lag(q) OVER w, 0), coalesce(lead(q) OVER w, 0)) = 0 OR q = 1 AND greatest(p, coalesce(lag(p) OVER w, 0), coalesce(lead(p) OVER w, 0)) = 0 THEN 1 ELSE 0 END AS un FROM c WINDOW w AS (PARTITION BY vec_id ORDER BY i)),
z AS (SELECT vec_id, s, sum(un) / sum(greatest(p, q)) AS r FROM u, (SELECT unnest([0, 8, 16, 24, 32, 40, 48, 56]) AS s) WHERE i >= s AND i < s + 16 GROUP BY ALL HAVING sum(greatest(p, q)) >= 9)
SELECT vec_id, coalesce(max(r), 0) AS diff FROM pr LEFT JOIN z USING (vec_id) GROUP BY vec_id""")
def _(spark, sf):
    return d.local_window_difference(ink_pairs(spark, sf), ["vec_id"], "a", "b", 16, 8, 9).select("vec_id", "diff")


SHIFT = "WITH " + RAST + PAIR + """, q AS (SELECT vec_id, list_transform(a, lambda x: x // 24) AS a, list_transform(b, lambda x: x // 24) AS b FROM pr),
m AS (SELECT vec_id, s, count(*) FILTER (WHERE a[i + 1 + greatest(0, -s)] <> b[i + 1 + greatest(0, s)]) / count(*) AS e FROM q, (SELECT unnest(range(-6, 7)) AS s), range(0, 64) g(i) WHERE i < 64 - abs(s) GROUP BY ALL)"""


@query("shift_tolerant_difference", SHIFT + """, k AS (SELECT vec_id, e, s FROM m WHERE s <> 0 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY e, abs(s), s) = 1)
SELECT vec_id, CASE WHEN z.e > 0.035 AND k.e < z.e THEN k.e ELSE z.e END AS diff, CAST(CASE WHEN z.e > 0.035 AND k.e < z.e THEN k.s ELSE 0 END AS INTEGER) AS shift FROM m z JOIN k USING (vec_id) WHERE z.s = 0""")
def _(spark, sf):
    p = raster_pairs(spark, sf)
    q = lambda c: F.transform(c, lambda x: F.floor(x / 24))
    return d.shift_tolerant_difference(p.select("vec_id", q("a").alias("a"), q("b").alias("b")), "a", "b", 0.1).select("vec_id", "diff", "shift")


@query("shift_tolerant_anchored", SHIFT + """, an AS (SELECT vec_id, list_filter(range(0, 64), lambda i: a[i + 1] >= 6) AS p, list_filter(range(0, 64), lambda i: b[i + 1] >= 6) AS r FROM q),
fi AS (SELECT vec_id, s, list_filter(p, lambda v: v > 4 AND v < 60 AND v + s > 4 AND v + s < 60) AS p, list_filter(r, lambda v: v > 4 AND v < 60 AND v - s > 4 AND v - s < 60) AS r FROM an, (SELECT unnest(range(-6, 7)) AS s) WHERE s <> 0),
ok AS (SELECT vec_id, s FROM fi WHERE len(p) >= 2 AND len(r) >= 2 AND list_max(p) - list_min(p) >= 16 AND list_max(r) - list_min(r) >= 16
 AND len(list_filter(p, lambda v: len(list_filter(r, lambda u: abs(v + s - u) <= 2)) = 0)) = 0 AND len(list_filter(r, lambda u: len(list_filter(p, lambda v: abs(v + s - u) <= 2)) = 0)) = 0),
k AS (SELECT m.vec_id, e, m.s FROM m JOIN ok ON ok.vec_id = m.vec_id AND ok.s = m.s QUALIFY row_number() OVER (PARTITION BY m.vec_id ORDER BY e, abs(m.s), m.s) = 1)
SELECT z.vec_id, CASE WHEN z.e > 0.035 AND k.e < z.e THEN k.e ELSE z.e END AS diff, CAST(CASE WHEN z.e > 0.035 AND k.e < z.e THEN k.s ELSE 0 END AS INTEGER) AS shift FROM m z LEFT JOIN k USING (vec_id) WHERE z.s = 0""")
def _(spark, sf):
    p = raster_pairs(spark, sf)
    q = lambda c: F.transform(c, lambda x: F.floor(x / 24))
    at = lambda c: F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.get(c, i) >= 6)
    p = p.select("vec_id", q("a").alias("a"), q("b").alias("b")).withColumns({"p": at(F.col("a")), "r": at(F.col("b"))})
    return d.shift_tolerant_difference(p, "a", "b", 0.1, anchors=("p", "r")).select("vec_id", "diff", "shift")


@query("masked_columns", "WITH " + RAST + """, c AS (SELECT vec_id, list_filter(range(0, 64), lambda i: raster[i + 1] > 160) AS k FROM ra)
SELECT vec_id, CASE WHEN len(k) BETWEEN 1 AND 5 THEN array_to_string(list_transform(range(0, 64), lambda i: CASE WHEN len(list_filter(k, lambda j: abs(i - j) <= 4)) > 0 THEN 1 ELSE 0 END), '') END AS mask FROM c""")
def _(spark, sf):
    tint = F.transform("raster", lambda x: F.when(x > 160, 1).otherwise(0))
    return rasters(spark, sf).withColumn("tint", tint).select("vec_id", joined(d.masked_columns(F.col("tint"), 64, 1), "").alias("mask"))


@query("numbered_identity", "WITH " + EVN + """, k AS (SELECT e.*, CASE WHEN e.event_type <> 'error' THEN CAST(json_extract_string(x.props, '$.k') AS INTEGER) // 10 END AS n FROM evn e JOIN events x USING (event_id)),
p AS (SELECT event_id, n, value, lag(n) OVER w AS pn, lag(value) OVER w AS pv FROM k WINDOW w AS (PARTITION BY e.user_id ORDER BY rn) QUALIFY pv IS NOT NULL)
SELECT event_id, CASE WHEN n <> pn THEN 1.0 ELSE abs(value - pv) / 500 END AS diff FROM p""".replace("PARTITION BY e.user_id", "PARTITION BY user_id").replace("SELECT e.*,", "SELECT e.user_id, e.event_id, e.rn, e.value,"))
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.floor(F.get_json_object("props", "$.k").cast("int") / 10).alias("k"))
    v = ev(spark, sf).join(e, "event_id").withColumn("n", F.when(F.col("event_type") != "error", F.col("k")))
    o = Ordered(v, KEY, ORD).with_columns(p=lag(F.struct("n", "value")))
    out = o.where(F.col("p").isNotNull()).result
    return out.select("event_id", d.numbered_identity(F.col("n"), F.col("p.n"), F.abs(F.col("value") - F.col("p.value")) / 500).alias("diff"))


@query("nearest_prototype", """WITH c AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, generate_series(1, 64) g(i) GROUP BY ALL),
e AS (SELECT v.vec_id, c.label, sum(abs(CAST(v.embedding[c.i] AS DOUBLE) - c.m)) / 64 AS err FROM embeddings v, c GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY err, label) AS rn, lead(err) OVER (PARTITION BY vec_id ORDER BY err, label) AS nx FROM e)
SELECT vec_id, CASE WHEN err <= 0.29 AND nx - err >= 0.002 THEN label END AS label, round(err, 6) AS err FROM r WHERE rn = 1""")
def _(spark, sf):
    e = table(spark, sf, "embeddings")
    c = e.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    c = c.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("proto"))
    return d.nearest_prototype(e, ["vec_id"], "embedding", c, "label", "proto", margin=0.002).withColumn("err", F.round("err", 6))


@query("digit_groups", """WITH e AS (SELECT user_id, event_id, floor(value) AS x, floor(value) + 4 AS x2, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'error' THEN 2 ELSE 9 END AS y, CAST(floor(value) AS INTEGER) % 10 AS dg FROM events),
s AS (SELECT *, CASE WHEN x - lag(x2) OVER w < 4.5 AND abs(y - lag(y) OVER w) < 2 THEN 0 ELSE 1 END AS nw FROM e WINDOW w AS (PARTITION BY user_id ORDER BY x, event_id)),
g AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY x, event_id) AS g FROM s),
n AS (SELECT user_id, min(x) AS l, max(x2) AS r, count(*) AS c, string_agg(dg::VARCHAR, '' ORDER BY x, event_id) AS ds FROM g GROUP BY user_id, g)
SELECT user_id, l AS "left", r AS "right", CAST(ds AS INTEGER) AS number FROM n WHERE c <= 3 AND CAST(ds[1:3] AS INTEGER) BETWEEN 1 AND 999""")
def _(spark, sf):
    x = F.floor("value").cast("double")
    e = table(spark, sf, "events").select("user_id", "event_id", x.alias("x"), (x + 4).alias("x2"), F.when(F.col("event_type") == "view", 0).when(
        F.col("event_type") == "click", 1).when(F.col("event_type") == "error", 2).otherwise(9).alias("y"), (F.floor("value") % 10).alias("dg"))
    return d.digit_groups(e, KEY, "x", "x2", "y", "dg", 10.0, ["event_id"])


@query("clipped_band_filter", """WITH x AS (SELECT user_id, event_id, CAST(ts AS DATE) - DATE '2024-01-01' AS day, epoch_us(ts) % 86400000000 / 1e6 AS f FROM events),
c AS (SELECT *, count(*) OVER (PARTITION BY user_id, day) AS n FROM x)
SELECT user_id, event_id FROM c WHERE n = 1 OR NOT (f < 7200 OR 86400 - (f + 600) < 7200 OR (f - 900 <= 2 AND f < 23400) OR (f + 12000 >= 86398 AND 86400 - (f + 600) < 12600))""")
def _(spark, sf):
    e = month(spark, sf)
    f = F.col("t") - F.floor(F.col("t") / 86400) * 86400
    x = e.select("user_id", "event_id", F.floor(F.col("t") / 86400).alias("day"), F.round(f, 6).alias("f")).withColumns(
        {"l": F.col("f") + 600, "s": F.lit(3600.0), "y0": F.col("f") - 900, "y1": F.col("f") + 12000})
    return b.clipped_band_filter(x, ["user_id", "day"], "f", "l", "s", 86400.0, "y0", "y1").select("user_id", "event_id")


@query("pair_adjacent", "WITH RECURSIVE " + EVN + """, x AS (SELECT user_id, rn, t AS f, t + 600 AS l, 3600.0::DOUBLE * (1 + event_id % 2) AS s, event_type = 'view' AS lk FROM evn),
y AS (SELECT *, lead(f) OVER w AS f1, lead(l) OVER w AS l1, lead(s) OVER w AS s1, lead(f, 2) OVER w AS f2, bool_or(lk) OVER (PARTITION BY user_id) AS anyl FROM x WINDOW w AS (PARTITION BY user_id ORDER BY rn)),
o AS (SELECT *, coalesce(CASE WHEN anyl THEN lk ELSE f2 IS NULL OR f1 - l <= f2 - l1 END AND s / s1 > 0.65 AND s / s1 < 1.55 AND f1 - l > least(s, s1) * 1.5 AND f1 - l < least(s, s1) * 22, false) AS ok FROM y),
g AS (SELECT user_id, rn, ok FROM o WHERE rn = 1 UNION ALL SELECT o.user_id, o.rn, o.ok FROM g JOIN o ON o.user_id = g.user_id AND o.rn = g.rn + CASE WHEN g.ok THEN 2 ELSE 1 END)
SELECT user_id, f AS first, l1 AS last, least(s, s1) AS spacing FROM g JOIN o USING (user_id, rn) WHERE g.ok""")
def _(spark, sf):
    x = ev(spark, sf).select("user_id", F.col("t").alias("f"), (F.col("t") + 600).alias("l"), (F.lit(3600.0) * (1 + F.col("event_id") % 2)).alias("s"), (F.col("event_type") == "view").alias("lk"))
    return b.pair_adjacent(x, KEY, "f", "l", "s", "lk")


ARB = "WITH " + EV + """, w AS (SELECT user_id, t AS f, t + 80000 AS l, value AS ef, value / 2 AS el FROM ev WHERE event_type = 'view'), n AS (SELECT user_id, t AS f, t + 10000 AS l, value AS ty FROM ev WHERE event_type = 'click'),
p AS (SELECT w.user_id, w.f AS wf, n.f AS nf, CASE WHEN abs(n.f - w.f) <= abs(n.l - w.l) THEN el ELSE ef END >= ty * 0.4 AS ok FROM w JOIN n ON n.user_id = w.user_id AND n.f >= w.f - 2 AND n.l <= w.l + 2),
s AS (SELECT user_id, wf, min(nf) AS stop FROM p WHERE NOT ok GROUP BY ALL)
"""


def candidates(spark, sf):
    e = ev(spark, sf)
    w = e.filter("event_type = 'view'").select("user_id", F.col("t").alias("f"), (F.col("t") + 80000).alias("l"), F.lit(100.0).alias("s"), F.col("value").alias("ef"), (F.col("value") / 2).alias("el"))
    n = e.filter("event_type = 'click'").select("user_id", F.col("t").alias("f"), (F.col("t") + 10000).alias("l"), F.lit(100.0).alias("s"), F.col("value").alias("ty"))
    return b.arbitrate_candidates(w, n, KEY, "f", "l", "s", "ty", "ef", "el", 100000.0)


@query("arbitrate_candidates", ARB + """SELECT user_id, f, 'wide' AS kind FROM w WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.user_id = w.user_id AND s.wf = w.f)
UNION ALL SELECT user_id, f, 'narrow' FROM n WHERE NOT EXISTS (SELECT 1 FROM p LEFT JOIN s ON s.user_id = p.user_id AND s.wf = p.wf WHERE p.user_id = n.user_id AND p.nf = n.f AND p.ok AND (stop IS NULL OR p.nf < stop))""")
def _(spark, sf):
    w, n = candidates(spark, sf)
    return w.select("user_id", "f", F.lit("wide").alias("kind")).unionByName(n.select("user_id", "f", F.lit("narrow").alias("kind")))


@query("panel_extent", ONE + """, sm AS (SELECT event_type, i, avg(x) OVER (PARTITION BY event_type ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS a FROM hs),
mid AS (SELECT (max(i) + 1) // 2 AS m FROM hs)
SELECT event_type, greatest(any_value(m) - 60, max(i) FILTER (WHERE i < m AND NOT a > 1.6) + 1) AS top, least(any_value(m) + 60, min(i) FILTER (WHERE i > m AND NOT a > 1.6)) AS bottom FROM sm, mid GROUP BY 1""")
def _(spark, sf):
    h = hourly(spark, sf)
    mid = ((h.agg(F.max("i")).first()[0] or 0) + 1) // 2
    lim = lambda v: F.lit(v).cast("bigint")
    return b.panel_extent(h, TYPE, "i", "x", F.lit(mid), 1.6, lim(mid - 60), lim(mid + 60))
