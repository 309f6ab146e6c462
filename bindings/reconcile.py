"""Reconciliation and review queries."""

from pyspark.sql import functions as F

from bindings import query, table
from bindings.streams import EVN, LI, ev
from obsflow.operators import reconcile as r
from obsflow.operators import sequence as q
from obsflow.plans.ordered import Ordered, dealt, lag, row_number, running_sum

ORD = ["l_partkey", "l_suppkey"]
READ = """rd AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
 CAST(l_quantity > 40 AS INTEGER) + CAST(l_tax > 0.06 AS INTEGER) AS issues, 1 - l_discount AS confidence,
 CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS sig, CAST(l_quantity AS INTEGER) || '|' || l_returnflag AS reading FROM lineitem)"""


def readings(spark, sf):
    qty = F.col("l_quantity").cast("int").cast("string")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", *ORD,
        ((F.col("l_quantity") > 40).cast("int") + (F.col("l_tax") > 0.06).cast("int")).alias("issues"),
        (1 - F.col("l_discount")).alias("confidence"), qty.alias("sig"), F.concat(qty, F.lit("|"), "l_returnflag").alias("reading"))


@query("merge_observations", "WITH " + READ + """ SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, issues, confidence, reading FROM rd
 QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY issues, confidence DESC, l_partkey, l_suppkey) = 1""")
def _(spark, sf):
    return r.merge_observations(readings(spark, sf), ["l_orderkey"], "l_linenumber", "issues", "confidence", ORD).drop("sig")


CONF = "WITH RECURSIVE " + READ + """, s AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) AS rn FROM rd),
f AS (SELECT l_orderkey, l_linenumber, rn, issues AS bi, confidence AS bc, reading AS br, false AS hit FROM s WHERE rn = 1
 UNION ALL SELECT s.l_orderkey, s.l_linenumber, s.rn, CASE WHEN b THEN s.issues ELSE bi END, CASE WHEN b THEN s.confidence ELSE bc END,
  CASE WHEN b THEN s.reading ELSE br END, s.reading <> f.br
 FROM f JOIN s ON s.l_orderkey = f.l_orderkey AND s.l_linenumber = f.l_linenumber AND s.rn = f.rn + 1,
 LATERAL (SELECT s.issues < bi OR (s.issues = bi AND s.confidence > bc) AS b) x),
g AS (SELECT l_orderkey, l_linenumber, bool_or(hit) AS run FROM f GROUP BY ALL),
m AS (SELECT l_orderkey, l_linenumber, count(DISTINCT sig) > 1 AS fin FROM rd GROUP BY ALL),
cf AS (SELECT l_orderkey, l_linenumber, CASE WHEN fin THEN 'music' ELSE 'annotation' END AS kind FROM g JOIN m USING (l_orderkey, l_linenumber) WHERE fin OR run)
"""


@query("conflicts", CONF + "SELECT * FROM cf")
def _(spark, sf):
    return r.conflicts(readings(spark, sf), ["l_orderkey"], "l_linenumber", "issues", "confidence", ORD, "reading", "sig")


@query("canonical_signature", """WITH n AS (SELECT *, CAST(1 + l_partkey % 4 AS INTEGER) AS s1, CAST(1 + l_suppkey % 4 AS INTEGER) AS s2,
 lower(l_returnflag) || ' ' || lower(l_linestatus) AS mk FROM lineitem),
t AS (SELECT *, '{"string":' || s1 || ',"marks":"' || array_to_string(list_sort(string_split(mk, ' ')), ' ') || '"}' AS j1, '{"string":' || s2 || ',"marks":""}' AS j2 FROM n)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, sha256('{"tempo":' || CAST(l_quantity AS INTEGER) || ',"events":[{"staff":1,"voice":1,"onset":' || CAST(l_tax AS DECIMAL(20,5))
 || ',"duration":' || CAST(l_discount AS DECIMAL(20,5)) || ',"grace":' || (l_discount = 0) || ',"notes":[' || CASE WHEN s2 <= s1 THEN j2 || ',' || j1 ELSE j1 || ',' || j2 END || ']}],"meter":[4,4],"pickup":false}') AS digest FROM t""")
def _(spark, sf):
    l = table(spark, sf, "lineitem")

    def note(s, m):
        return F.struct(s.cast("int").alias("string"), m.alias("marks"))

    notes = F.array(note(1 + F.col("l_partkey") % 4, F.concat_ws(" ", F.lower("l_returnflag"), F.lower("l_linestatus"))), note(1 + F.col("l_suppkey") % 4, F.lit("")))
    events = F.array(F.struct(F.col("l_tax").alias("onset"), F.col("l_discount").alias("duration"), F.lit(1).alias("voice"), F.lit(1).alias("staff"),
                              notes.alias("notes"), F.lit("prose").alias("marks")))
    d = r.canonical_signature(F.array(F.lit(4), F.lit(4)), F.lit(False), events, {"tempo": F.col("l_quantity").cast("int")}, ["string", "marks"])
    return l.select("l_orderkey", "l_linenumber", *ORD, d.alias("digest"))


BARS = """e0 AS (SELECT l_orderkey, l_linenumber, row_number() OVER w AS pos,
 (coalesce(sum(CAST(l_quantity AS INTEGER)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / 10 AS onset, l_quantity / 10 AS duration,
 1 AS staff, CAST(1 + l_suppkey % 2 AS INTEGER) AS voice, 1 + l_partkey % 5 AS string, l_suppkey % 40 AS fret, l_returnflag FROM lineitem
 WINDOW w AS (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity)),
b0 AS (SELECT l_orderkey, l_linenumber, CASE WHEN min(l_partkey) % 17 = 0 THEN 33 ELSE 4 END AS num, 1 - 2 * max(l_discount) AS confidence, min(l_tax) = 0 AS pickup, max(l_tax) >= 0.08 AS high FROM lineitem GROUP BY ALL)"""


def bars(spark, sf):
    by = ["l_orderkey", "l_linenumber"]
    l, deal = dealt(table(spark, sf, "lineitem"), by)
    b = l.groupBy(*by).agg(
        F.when(F.min("l_partkey") % 17 == 0, 33).otherwise(4).alias("num"), F.lit(4).alias("den"), (F.min("l_tax") == 0).alias("pickup"),
        (1 - 2 * F.max("l_discount")).alias("confidence"), F.when(F.max("l_tax") >= 0.08, F.array(F.lit("High tax"))).otherwise(F.array().cast("array<string>")).alias("issues"))
    o = Ordered(l, by, [*ORD, "l_quantity"], chunked=deal.chunked).with_columns(pos=row_number(), _on=running_sum(F.col("l_quantity").cast("int"), inclusive=False))
    note = F.struct((1 + F.col("l_partkey") % 5).alias("string"), (F.col("l_suppkey") % 40).cast("string").alias("fret"),
                    F.when(F.col("l_returnflag") == "A", "slap").otherwise("weird slap").alias("marks"))
    notes = F.when(F.col("l_returnflag") == "N", F.array().cast("array<struct<string:bigint,fret:string,marks:string>>")).otherwise(F.array(note))
    e = o.result.select(*by, "pos", (F.col("_on") / 10).alias("onset"), (F.col("l_quantity") / 10).alias("duration"), F.lit(1).alias("staff"),
                        (1 + F.col("l_suppkey") % 2).cast("int").alias("voice"), F.lit("").alias("marks"), notes.alias("notes"))
    return b, e, deal


def issues(spark, sf):
    b, e, deal = bars(spark, sf)
    return r.bar_issues(b, e, ["l_orderkey", "l_linenumber"], "bass", deal=deal)


ISSUES = "WITH " + BARS + """, e1 AS (SELECT e0.*, pickup FROM e0 JOIN b0 USING (l_orderkey, l_linenumber) WHERE num <> 33),
t AS (SELECT *, coalesce(lag(onset + duration) OVER v, 0) AS cur, lead(pos) OVER v IS NULL AS fin, min(pos) OVER (PARTITION BY l_orderkey, l_linenumber, voice) AS fp FROM e1 WINDOW v AS (PARTITION BY l_orderkey, l_linenumber, voice ORDER BY onset, pos)),
i AS (SELECT l_orderkey, l_linenumber, 0 AS a, 0 AS p, 0 AS s, 'High tax' AS issue FROM b0 WHERE high
UNION ALL SELECT l_orderkey, l_linenumber, 1, 0, 0, 'Invalid time signature' FROM b0 WHERE num = 33
UNION ALL SELECT l_orderkey, l_linenumber, 1, 0, 1, 'Visual reading needs review' FROM b0 WHERE num <> 33 AND confidence < 0.85
UNION ALL SELECT l_orderkey, l_linenumber, 2, pos, 0, 'Event falls outside the measure' FROM e1 WHERE onset + duration > 4.001
UNION ALL SELECT l_orderkey, l_linenumber, 2, pos, 1, 'Notation requiring manual engraving: weird' FROM e1 WHERE l_returnflag = 'R'
UNION ALL SELECT l_orderkey, l_linenumber, 2, pos, 2, 'Invalid TAB string or fret' FROM e1 WHERE l_returnflag <> 'N' AND (string > 4 OR fret > 36)
UNION ALL SELECT l_orderkey, l_linenumber, 3, 0, 0, 'Independent TAB voices require manual engraving' FROM e1 GROUP BY l_orderkey, l_linenumber HAVING count(DISTINCT voice) > 1
UNION ALL SELECT l_orderkey, l_linenumber, 4, fp, 0, 'Gap or overlap in staff 1, voice ' || voice FROM t WHERE abs(onset - cur) > 0.001
UNION ALL SELECT l_orderkey, l_linenumber, 4, fp, 1, 'Incomplete rhythm in staff 1, voice ' || voice FROM t WHERE fin AND NOT pickup AND abs(onset + duration - 4) > 0.001),
u AS (SELECT l_orderkey, l_linenumber, issue, min((a, p, s)) AS k FROM i GROUP BY ALL)
"""


@query("bar_issues", ISSUES + "SELECT l_orderkey, l_linenumber, CAST(k[1] AS INTEGER) AS stage, CAST(k[2] AS BIGINT) AS pos, issue FROM u")
def _(spark, sf):
    return issues(spark, sf).drop("sub")


@query("needs_review", ISSUES + """SELECT l_orderkey, l_linenumber, bool_or(NOT (issue LIKE 'Notation requiring manual engraving:%' OR issue LIKE 'Independent TAB voices require%')) AS needs_review FROM u GROUP BY ALL""")
def _(spark, sf):
    return r.needs_review(issues(spark, sf), ["l_orderkey", "l_linenumber"])


@query("score_bar_problems", ISSUES + """, sc AS (SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'F' THEN 6 ELSE 0 END AS hi FROM orders),
x AS (SELECT l_orderkey AS k, l_linenumber AS n, count(*) AS c FROM lineitem GROUP BY ALL),
m AS (SELECT k, CASE WHEN hi > 0 THEN hi ELSE max(n) END AS top FROM sc JOIN x USING (k) GROUP BY k, hi)
SELECT k, 'Duplicate measure numbers' AS issue, CAST(n AS BIGINT) AS number FROM x JOIN sc USING (k) WHERE c > 1
UNION ALL (SELECT k, 'Missing bars', unnest(range(2, top + 1)) AS q FROM m EXCEPT SELECT k, 'Missing bars', n FROM x)
UNION ALL SELECT k, 'No measures transcribed', NULL FROM sc WHERE k NOT IN (SELECT k FROM x)
UNION ALL SELECT l_orderkey, 'Bar ' || l_linenumber || ': ' || issue, l_linenumber FROM u""")
def _(spark, sf):
    sc = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.lit(2).alias("lo"), F.when(F.col("o_orderstatus") == "F", 6).otherwise(0).alias("hi"))
    b = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"))
    own = issues(spark, sf).select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), "issue")
    return r.score_issues(b, sc, ["k"], "n", "lo", "hi", own).withColumnsRenamed({"n": "number"})


@query("score_issues", """WITH sc AS (SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'F' THEN 6 ELSE 0 END AS hi FROM orders),
x AS (SELECT l_orderkey AS k, l_linenumber AS n, count(*) AS c FROM lineitem GROUP BY ALL),
m AS (SELECT k, CASE WHEN hi > 0 THEN hi ELSE max(n) END AS top FROM sc JOIN x USING (k) GROUP BY k, hi)
SELECT k, 'Duplicate measure numbers' AS issue, CAST(n AS BIGINT) AS number FROM x JOIN sc USING (k) WHERE c > 1
UNION ALL SELECT k, 'Missing bars', unnest(range(2, top + 1)) AS q FROM m
EXCEPT SELECT k, 'Missing bars', n FROM x
UNION ALL SELECT k, 'No measures transcribed', NULL FROM sc WHERE k NOT IN (SELECT k FROM x)""")
def _(spark, sf):
    sc = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.lit(2).alias("lo"), F.when(F.col("o_orderstatus") == "F", 6).otherwise(0).alias("hi"))
    b = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"))
    out = r.score_issues(b, sc, ["k"], "n", "lo", "hi")
    return out.withColumnsRenamed({"n": "number"})


@query("tie_and_sum_check", "WITH " + """e AS (SELECT *, CASE WHEN l_discount > 0.05 THEN 't' ELSE '' END || CASE WHEN l_tax > 0.04 THEN 'c' ELSE '' END AS mk FROM lineitem),
n AS (SELECT *, lead(l_returnflag) OVER w AS ns, lead(l_linestatus) OVER w AS nf, lead(mk) OVER w AS nm FROM e WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey))
SELECT l_orderkey, l_linenumber, 'durations' AS issue, CAST(1 AS BIGINT) AS n FROM lineitem GROUP BY ALL HAVING sum(l_quantity) <> 40
UNION ALL SELECT l_orderkey, l_linenumber, 'tie', count(*) FROM n WHERE mk LIKE '%t%' AND NOT coalesce(ns = l_returnflag AND nf = l_linestatus AND nm LIKE '%c%', false) GROUP BY ALL""")
def _(spark, sf):
    mk = F.concat(F.when(F.col("l_discount") > 0.05, "t").otherwise(""), F.when(F.col("l_tax") > 0.04, "c").otherwise(""))
    e = table(spark, sf, "lineitem").withColumn("mk", mk)
    return r.tie_and_sum_check(e, ["l_orderkey"], "l_linenumber", ORD, "l_quantity", "l_returnflag", "l_linestatus", "mk", 40.0)


@query("expand_shorthand", r"""WITH w AS (SELECT doc_id, string_split_regex(text, '[ \n]+') AS ws FROM documents),
t AS (SELECT doc_id, unnest(ws) AS f, unnest(range(len(ws))) AS i, len(ws) AS n FROM w)
SELECT doc_id, string_agg('E' || f || ':.5:' || CASE WHEN i = 0 THEN 'i' WHEN i = n - 1 THEN 'o' ELSE '' END, ' ' ORDER BY i) AS tokens FROM t GROUP BY doc_id""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", r.expand_shorthand(F.lit("E"), F.split("text", "[ \n]+"), F.lit("i"), F.lit("o")).alias("tokens"))


@query("expand_shorthand_lines", """WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line_text, unnest(range(len(ls))) AS line FROM s),
w AS (SELECT doc_id, line, string_split(line_text, ' ') AS ws FROM l),
t AS (SELECT doc_id, line, unnest(ws) AS f, unnest(range(len(ws))) AS i, len(ws) AS n FROM w)
SELECT doc_id, CAST(line AS INTEGER) AS line, string_agg('E' || f || ':.5:' || CASE WHEN i = 0 THEN 'i' WHEN i = n - 1 THEN 'o' ELSE '' END, ' ' ORDER BY i) AS tokens FROM t GROUP BY doc_id, line""")
def _(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "line_text"))
    return lines.select("doc_id", "line", r.expand_shorthand(F.lit("E"), F.split("line_text", " "), F.lit("i"), F.lit("o")).alias("tokens"))


@query("tokenize_events", r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(text, '[ \n]+', ':1.5 ', 'g'), '[ \t\n\v\f\r]+'), lambda x: x <> '') AS ws FROM documents),
t AS (SELECT doc_id, i - 1 AS pos, string_split(ws[i], ':') AS p FROM w, LATERAL (SELECT unnest(range(1, len(ws) + 1)) AS i))
SELECT doc_id, CAST(pos AS INTEGER) AS pos, CASE WHEN p[1] <> 'R' THEN substr(p[1], 1, 1) END AS string, CASE WHEN p[1] <> 'R' THEN substr(p[1], 2) END AS fret,
 CASE WHEN regexp_matches(p[2], '^[0-9]*\.?[0-9]+$') THEN CAST(p[2] AS DOUBLE) END AS duration, coalesce(p[3], '') AS marks FROM t""")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.regexp_replace("text", r"[ \n]+", ":1.5 ").alias("text"))
    return r.tokenize_events(d, "text")


@query("expand_repeats", """WITH RECURSIVE c AS (SELECT o_orderkey AS n, o_orderstatus AS st, o_totalprice AS price, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS ref FROM orders),
f AS (SELECT n, n AS root FROM c WHERE st = 'F' UNION ALL SELECT c.n, f.root FROM f JOIN c ON c.ref = f.n WHERE c.st <> 'F')
SELECT c.n, r.price, CASE WHEN f.root IS NULL THEN 'unknown reference' END AS error FROM c LEFT JOIN f USING (n) LEFT JOIN c r ON r.n = f.root""")
def _(spark, sf):
    o = table(spark, sf, "orders").withColumn("k", F.lit(1))
    c = Ordered(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).with_columns(ref=lag("o_orderkey")).result
    c = c.select("o_orderstatus", F.col("o_orderkey").alias("n"), F.col("o_totalprice").alias("price"), "ref")
    base, rep = c.filter("o_orderstatus = 'F'").select("n", "price"), c.filter("o_orderstatus <> 'F'").select("n", "ref")
    return r.expand_repeats(base, rep, [], "n", "ref", ["price"], {})


@query("review_targets", CONF + """, fl AS (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING max(l_tax) >= 0.08),
dn AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_linestatus = 'F')
SELECT l_orderkey, l_linenumber FROM (SELECT l_orderkey, l_linenumber FROM cf WHERE kind = 'music' UNION SELECT * FROM fl) EXCEPT SELECT * FROM dn""")
def _(spark, sf):
    by = ["l_orderkey", "l_linenumber"]
    l = table(spark, sf, "lineitem")
    cf = r.conflicts(readings(spark, sf), ["l_orderkey"], "l_linenumber", "issues", "confidence", ORD, "reading", "sig").filter("kind = 'music'")
    flagged = l.filter("l_tax >= 0.08").select(*by)
    return r.review_targets([cf, flagged], l.filter("l_linestatus = 'F'").select(*by).distinct(), ["l_orderkey"], "l_linenumber")


@query("review_windows", "WITH RECURSIVE " + EVN + """, m AS (SELECT user_id, rn AS number, CAST(floor((t - 1704067200) / 14400) AS DOUBLE) AS ts, event_type, value FROM evn),
br AS (SELECT * FROM m WHERE event_type <> 'error'), tg AS (SELECT * FROM m WHERE event_type = 'error' OR value > 150),
c AS (SELECT tg.user_id, tg.number, br.ts AS own, (SELECT max(number) FROM br x WHERE x.user_id = tg.user_id AND x.number < tg.number) AS b, (SELECT min(number) FROM br x WHERE x.user_id = tg.user_id AND x.number > tg.number) AS a
 FROM tg LEFT JOIN br ON br.user_id = tg.user_id AND br.number = tg.number),
d AS (SELECT c.user_id, c.number, greatest(0, least(179.8, coalesce(own, CASE WHEN b IS NULL THEN 0 WHEN a IS NULL THEN 177 ELSE (xb.ts + xa.ts) / 2 END))) AS center
 FROM c LEFT JOIN br xb ON xb.user_id = c.user_id AND xb.number = c.b LEFT JOIN br xa ON xa.user_id = c.user_id AND xa.number = c.a),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY center, number) AS i FROM d),
f AS (SELECT user_id, number, i, center, center AS c0, 1 AS sz, 1 AS grp FROM o WHERE i = 1
 UNION ALL SELECT o.user_id, o.number, o.i, o.center, CASE WHEN nw THEN o.center ELSE c0 END, CASE WHEN nw THEN 1 ELSE sz + 1 END, CASE WHEN nw THEN grp + 1 ELSE grp END
 FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1, LATERAL (SELECT o.center - c0 > 3 OR sz >= 3 AS nw) z),
g AS (SELECT user_id, grp, list(number ORDER BY i) AS ns, list(center ORDER BY i) AS cs FROM f GROUP BY ALL),
h AS (SELECT *, list_sum(cs) / len(cs) AS mid FROM g)
SELECT user_id, CAST(grp AS BIGINT) AS grp, array_to_string(ns, ',') AS numbers,
 CAST(len(list_distinct(list_transform(list_concat(list_transform([-3, -1.5, -0.5, 0, 0.5, 1.5, 3], lambda q: mid + q::DOUBLE), cs), lambda q: greatest(0, least(179.88, q))))) AS INTEGER) AS n_times, greatest(0, least(mid - 3, list_min(cs))) AS first_time FROM h""")
def _(spark, sf):
    o = Ordered(ev(spark, sf), ["user_id"], ["t", "event_id"]).with_columns(number=row_number())
    m = o.result.withColumn("ts", F.floor((F.col("t") - 1704067200) / 14400).cast("double"))
    dur = m.groupBy("user_id").agg(F.lit(180.0).alias("duration"))
    w = r.review_windows(m.filter("event_type = 'error' or value > 150"), m.filter("event_type <> 'error'"), ["user_id"], "number", "ts", dur)
    return w.select("user_id", "grp", F.array_join(F.transform("numbers", lambda x: x.cast("string")), ",").alias("numbers"),
                    F.size("times").alias("n_times"), F.col("times")[0].alias("first_time"))


@query("disposition_check", """WITH rq AS (SELECT doc_id FROM documents WHERE n_chars > 400), x AS (
SELECT doc_id, 'r' AS k FROM rq UNION ALL SELECT doc_id, 'c' FROM labels WHERE quality = 0 UNION ALL SELECT doc_id, 'o' FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 'u' FROM labels WHERE toxic = 1
 UNION ALL SELECT doc_id, 'f' FROM documents WHERE lang = 'de'),
g AS (SELECT doc_id, count(*) FILTER (WHERE k = 'r') AS r, count(*) FILTER (WHERE k = 'c') AS c, count(*) FILTER (WHERE k = 'o') AS o, count(*) FILTER (WHERE k = 'u') AS u, count(*) FILTER (WHERE k = 'f') AS f FROM x GROUP BY 1),
s AS (SELECT doc_id, f, CASE WHEN r = 0 AND c + o + u > 0 THEN 'unrelated' WHEN c + o + u > 1 THEN 'duplicate' WHEN r > 0 AND c + o + u = 0 THEN 'no decision' WHEN c > 0 THEN 'changed' WHEN o > 0 THEN 'confirmed' WHEN u > 0 THEN 'unreadable' END AS status FROM g)
SELECT doc_id, status, status IN ('changed', 'confirmed') AND f = 0 AS cleared FROM s WHERE status IS NOT NULL""")
def _(spark, sf):
    d, l = table(spark, sf, "documents"), table(spark, sf, "labels")
    return r.disposition_check(d.filter("n_chars > 400"), l.filter("quality = 0"), l.filter("quality = 1"), l.filter("toxic = 1"), [], "doc_id", d.filter("lang = 'de'"))


DOCS = """dn AS (SELECT source, doc_id, text, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS idx, count(*) OVER (PARTITION BY source) AS n FROM documents),
dd AS (SELECT *, coalesce(lag(idx) OVER (PARTITION BY source, text ORDER BY idx), 0) AS dup FROM dn)"""


def numbered_docs(spark, sf):
    d = table(spark, sf, "documents").select("source", "doc_id", "n_chars", F.md5("text").alias("digest"))
    d = Ordered(d, ["source"], ["doc_id"]).with_columns(idx=row_number()).result
    return Ordered(d, ["source", "digest"], ["idx"]).with_columns(_p=lag("idx")).result.withColumn("dup", F.coalesce("_p", F.lit(0))).drop("_p")


@query("line_check_merge", "WITH " + DOCS + """, w AS (SELECT *, b AS batch, b * 7 + 1 AS lo, b * 7 + 8 AS hi FROM dd, LATERAL (SELECT unnest(range(0, n)) AS b)
 WHERE idx - 1 >= b * 7 AND idx - 1 < b * 7 + 8 AND (b = 0 OR (b - 1) * 7 + 8 < n)),
v AS (SELECT source, idx, batch, n_chars % 50 AS first_bar, n_chars % 47 + 10 * (batch % 2) AS last_bar, dup FROM w)
SELECT source, idx, batch, first_bar, last_bar FROM v WHERE NOT (last_bar > 0 AND last_bar < first_bar) QUALIFY row_number() OVER (PARTITION BY source, idx ORDER BY batch) = 1""")
def _(spark, sf):
    w = q.count_windows(numbered_docs(spark, sf), ["source"], ["idx"])
    f = w.select("source", "idx", "batch", (F.col("n_chars") % 50).alias("first_bar"), (F.col("n_chars") % 47 + 10 * (F.col("batch") % 2)).alias("last_bar"),
                 F.col("dup").alias("duplicate_of"), (F.col("batch") * 7 + 1).alias("lo"), (F.col("batch") * 7 + 8).alias("hi"))
    return r.line_check_merge(f, ["source"], "idx", "batch", "lo", "hi")[0].select("source", "idx", "batch", "first_bar", "last_bar")


@query("exclude_duplicates", "WITH RECURSIVE " + DOCS + """, b AS (SELECT source, idx, dup, n_chars % 7 <> 0 AS inc FROM dd),
f AS (SELECT source, idx, inc AS kept FROM b WHERE dup = 0 UNION ALL SELECT b.source, b.idx, b.inc AND NOT f.kept FROM f JOIN b ON b.source = f.source AND b.dup = f.idx)
SELECT f.source, f.idx, kept, CASE WHEN inc AND NOT kept THEN 'Duplicate of line ' || dup END AS note FROM f JOIN b ON b.source = f.source AND b.idx = f.idx""")
def _(spark, sf):
    d = numbered_docs(spark, sf).withColumns({"inc": F.col("n_chars") % 7 != 0, "same": F.lit(True)})
    return r.exclude_duplicates(d, ["source"], "idx", "inc", "dup", "same").select("source", "idx", "kept", "note")


@query("confident_reorder", "WITH " + LI + """, x AS (SELECT l_orderkey AS k, seq, l_tax < 0.07 AS inc, CAST(l_shipdate AS DATE) - DATE '1990-01-01' AS tm, CASE WHEN l_quantity < 49 THEN l_partkey ELSE 0 END AS fb, l_partkey + CAST(l_quantity AS INTEGER) AS lb, 1 - l_discount AS cf FROM li),
i AS (SELECT *, lag(greatest(lb, 0)) OVER (PARTITION BY k ORDER BY fb, lb, seq) AS pv, bool_and(fb > 0 AND cf >= 0.905) OVER (PARTITION BY k) AS sure, lag(fb) OVER (PARTITION BY k ORDER BY seq) AS pf FROM x WHERE inc),
g AS (SELECT k, bool_and(sure) AS sure, bool_and(pv IS NULL OR pv < fb) AS clr FROM i GROUP BY k),
j AS (SELECT x.*, coalesce(sure, false) AS sure, coalesce(sure AND clr, false) AS ap, (SELECT i.pf FROM i WHERE i.k = x.k AND i.seq = x.seq) AS pf FROM x LEFT JOIN g USING (k))
SELECT k AS l_orderkey, seq AS idx, row_number() OVER (PARTITION BY k ORDER BY CASE WHEN ap AND NOT inc THEN 1 ELSE 0 END, CASE WHEN ap AND inc THEN fb ELSE 0 END, CASE WHEN ap AND inc THEN tm ELSE 0 END, seq) AS seq,
 CASE WHEN ap THEN NULL WHEN sure THEN 'overlapping ranges' WHEN inc AND fb > 0 AND pf > 0 AND fb < pf THEN 'backwards' END AS warning FROM j""")
def _(spark, sf):
    o = Ordered(table(spark, sf, "lineitem"), ["l_orderkey"], ["l_linenumber", *ORD]).with_columns(idx=row_number())
    x = o.result.select("l_orderkey", "idx", (F.col("l_tax") < 0.07).alias("inc"), F.unix_date(F.col("l_shipdate").cast("date")).alias("tm"),
                        F.when(F.col("l_quantity") < 49, F.col("l_partkey")).otherwise(0).alias("fb"), (F.col("l_partkey") + F.col("l_quantity").cast("int")).alias("lb"),
                        (1 - F.col("l_discount")).alias("cf"))
    return r.confident_reorder(x, ["l_orderkey"], "idx", "tm", "inc", "fb", "lb", "cf", F.lit(True), 0.905)


@query("merge_text_rows", """WITH RECURSIVE c AS (SELECT role, turn + 1 AS number, conv_id, text, 1 - (length(text) % 30) / 100 AS cf, row_number() OVER (PARTITION BY role, turn ORDER BY conv_id) AS rn FROM conversations WHERE length(text) > 0),
f AS (SELECT role, number, rn, text AS bt, cf AS bc, 0 AS d FROM c WHERE rn = 1
 UNION ALL SELECT c.role, c.number, c.rn, CASE WHEN c.cf > f.bc THEN c.text ELSE f.bt END, greatest(c.cf, f.bc), d + CASE WHEN c.text <> f.bt THEN 1 ELSE 0 END FROM f JOIN c ON c.role = f.role AND c.number = f.number AND c.rn = f.rn + 1)
SELECT role, number, bt AS text, bc AS confidence, CAST(d AS BIGINT) AS disagreements, bc < 0.85 AS low_confidence FROM f QUALIFY row_number() OVER (PARTITION BY role, number ORDER BY rn DESC) = 1""")
def _(spark, sf):
    d = table(spark, sf, "conversations").select("role", (F.col("turn") + 1).alias("number"), "conv_id", "text", (1 - (F.length("text") % 30) / 100).alias("confidence"))
    return r.merge_text_rows(d, ["role"], "number", "text", "confidence", ["conv_id"])


@query("apply_marks", """WITH b AS (SELECT doc_id, string_split(text, ' ') AS ws FROM documents), e AS (SELECT doc_id, quality * 450 + 100 AS nt, CASE WHEN toxic = 1 THEN 'A' ELSE '' END AS nl FROM labels),
j AS (SELECT b.doc_id, ws, nt, nl, nt IS NOT NULL AND nt <= 400 AS ok FROM b LEFT JOIN e USING (doc_id)),
k AS (SELECT *, CASE WHEN ok THEN list_transform(ws, lambda w: CASE WHEN w IN ('the', 'la') THEN '' ELSE w END) ELSE ws END AS nw FROM j)
SELECT doc_id, CASE WHEN ok THEN nt ELSE 0 END AS tempo, CASE WHEN ok THEN nl ELSE 'B' END AS label, md5(array_to_string(nw, ' ')) AS words, ok AS changed, nt IS NOT NULL AND nt > 400 AS rejected FROM k""")
def _(spark, sf):
    b = table(spark, sf, "documents").select("doc_id", F.lit(0).alias("tempo"), F.lit("B").alias("label"), F.split("text", " ").alias("words"))
    e = table(spark, sf, "labels").select("doc_id", (F.col("quality") * 450 + 100).alias("new_tempo"), F.when(F.col("toxic") == 1, "A").otherwise("").alias("new_label"),
                                          F.array(F.lit("the"), F.lit("la")).alias("remove"))
    out = r.apply_marks(b, e, ["doc_id"], "tempo", "label", "words")
    return out.withColumn("words", F.md5(F.array_join("words", " ")))


@query("content_identity", """SELECT doc_id, substr(sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '"}'), 1, 20) AS digest FROM documents""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", r.content_identity(["doc_id", "lang"], 20).alias("digest"))
