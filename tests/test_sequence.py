import random

from conftest import rows
from pyspark.sql import functions as F

from obsflow.operators import sequence as q

KEY = ["s"]


def samples(spark, values, step=1.0, key="a"):
    return spark.createDataFrame([(key, i, i * step, v) for i, v in enumerate(values)], "s string, seq int, t double, sig double")


def test_return_of_a_view_survives(sized):
    d = samples(sized, [1.0] * 4 + [2.0] * 4 + [1.0] * 4)
    v = q.stable_views(d, KEY, ["seq"], "t", "sig", 0.035, 1.0)
    assert rows(v, "view", "t0", "until", "count") == [(1, 0.0, 4.0, 4), (2, 4.0, 8.0, 4), (3, 8.0, 12.0, 4)]


def test_slow_drift_ends_a_view(sized):
    # Each step is within the threshold of the one before, but not of the first.
    d = samples(sized, [0.0, 0.03, 0.06, 0.09, 0.12, 0.15])
    v = q.stable_views(d, KEY, ["seq"], "t", "sig", 0.035, 1.0)
    assert rows(v, "view", "count") == [(1, 2), (2, 2), (3, 2)]


def test_blank_closes_without_opening(sized):
    d = samples(sized, [1.0, 1.0, None, None, 1.0, 1.0, 5.0])
    v = q.stable_views(d, KEY, ["seq"], "t", "sig", 0.1, 1.0, end=6.5)
    assert rows(v, "view", "t0", "until", "count") == [(1, 0.0, 2.0, 2), (2, 4.0, 6.0, 2), (3, 6.0, 6.5, 1)]
    kept, report = q.min_support(v, KEY)
    assert kept.count() == 2 and rows(report, "kept", "rejected") == [(2, 1)]


def test_views_do_not_depend_on_input_order_or_form(spark):
    rnd = random.Random(7)
    data = [(f"k{rnd.choice([0, 0, 0, 1, 2])}", i, float(i), rnd.choice([0.0, 0.02, 0.05, 1.0, 1.02])) for i in range(300)]
    schema = "s string, seq int, t double, sig double"

    def run(rws):
        d = spark.createDataFrame(rws, schema).repartition(3)
        return rows(q.stable_views(d, KEY, ["seq"], "t", "sig", 0.035, 1.0))

    want = run(data)
    rnd.shuffle(data)
    assert run(data) == want
    spark.conf.set("spark.obsflow.group.rows", "10")
    try:
        assert run(data) == want
    finally:
        spark.conf.unset("spark.obsflow.group.rows")


def pages(spark, rws):
    return spark.createDataFrame([("a", i, r) for i, r in enumerate(rws)], "s string, page int, rows array<string>")


def test_overlap_of_consecutive_pages_only(sized):
    d = pages(sized, [["a", "b"], ["b", "c"], ["a", "b"], [], ["a", "b"]])
    out = rows(q.overlap_trim(d, KEY, ["page"], "rows"), "page", "rows", "overlap")
    assert out == [(0, ["a", "b"], 0), (1, ["c"], 1), (2, ["a", "b"], 0), (3, [], 0), (4, ["a", "b"], 0)]
    assert sum(len(r[1]) for r in out) == 7 and sum(r[2] for r in out) == 1


def test_overlap_takes_the_longest_match(sized):
    d = pages(sized, [["x", "a", "a"], ["a", "a", "b"], ["b"], ["b"]])
    assert rows(q.overlap_trim(d, KEY, ["page"], "rows"), "page", "overlap") == [(0, 0), (1, 2), (2, 1), (3, 1)]


def test_overlap_of_long_views(spark):
    n = 10_000
    names = [f"r{i}" for i in range(n)]
    # A long overlap, a view that only repeats one row, and one whose ends agree at every length.
    d = pages(spark, [names, names[4000:] + ["x"] * 4000, ["x"] * n, ["x"] * (n - 1) + ["y"]])
    assert rows(q.overlap_trim(d, KEY, ["page"], "rows"), "page", "overlap") == [(0, 0), (1, 6000), (2, 4000), (3, n - 1)]


def test_overlap_against_the_plain_rule(spark):
    rnd = random.Random(9)
    views = [[rnd.choice("ab") for _ in range(rnd.randrange(7))] for _ in range(80)]
    want = [(0, 0)]
    for i in range(1, 80):
        a, b = views[i - 1:i + 1]
        want.append((i, max((k for k in range(1, min(len(a), len(b)) + 1) if a[-k:] == b[:k]), default=0)))
    assert rows(q.overlap_trim(pages(spark, views), KEY, ["page"], "rows"), "page", "overlap") == want


def test_overlap_blank_marks(sized):
    d = pages(sized, [["a"], ["a"], ["-"], ["a"]])
    out = q.overlap_trim(d, KEY, ["page"], "rows", blank=F.array_contains("rows", "-"))
    assert rows(out, "page", "overlap") == [(0, 0), (1, 1), (2, 0), (3, 0)]


def test_anchor_holds_while_nudged_rows_are_dropped(sized):
    # original, nudged, changed, original: the nudge is a repeat, and does not chain.
    d = sized.createDataFrame([("a", i, [v]) for i, v in enumerate([0.0, 0.03, 0.06, 0.0])], "s string, page int, rows array<double>")
    same = lambda a, b: abs(a - b) < 0.035
    out = q.overlap_trim(d, KEY, ["page"], "rows", multi_only=True, hold_anchor=True, same_value=same)
    assert rows(out, "page", "overlap") == [(0, 0), (1, 1), (2, 0), (3, 0)]


def test_hold_dedup(sized):
    d = sized.createDataFrame([("a", i, i * 2.0, "x") for i in range(12)], "s string, seq int, t double, f string")
    every = q.hold_dedup(d, KEY, ["seq"], "t", "f", enabled=F.lit(False))
    assert every.count() == 12
    kept = [r[0] for r in rows(q.hold_dedup(d, KEY, ["seq"], "t", "f"), "t")]
    assert len(kept) < 12 and kept[0] == 0 and kept[-1] == 22
    assert all(b - a <= 6 for a, b in zip(kept, kept[1:]))
    aba = sized.createDataFrame([("a", i, i * 2.0, f) for i, f in enumerate("ABA")], "s string, seq int, t double, f string")
    assert q.hold_dedup(aba, KEY, ["seq"], "t", "f").count() == 3


def reference_hold(rws, beat):
    """The rule read aloud, one row at a time."""
    out, prev, last, pending = [], None, None, None
    for i, (t, f) in enumerate(rws):
        if f == prev and out and t - last < beat and i < len(rws) - 1:
            pending = (t, f)
        else:
            if pending:
                out.append(pending)
                pending = None
            out.append((t, f))
            last = t
        prev = f
    return out


def test_hold_dedup_against_the_plain_rule(sized):
    rnd = random.Random(3)
    t, rws = 0.0, []
    for _ in range(80):
        t += rnd.choice([0.5, 1.0, 2.5, 7.0])
        rws.append((t, rnd.choice("AAB")))
    d = sized.createDataFrame([("a", i, *r) for i, r in enumerate(rws)], "s string, seq int, t double, f string")
    assert rows(q.hold_dedup(d, KEY, ["seq"], "t", "f"), "t", "f") == reference_hold(rws, 6.0)


def test_count_windows(sized):
    d = sized.range(121).select(F.lit("a").alias("s"), F.col("id").alias("i"))
    w = q.count_windows(d, KEY, ["i"], 8, 1)
    assert w.select("batch").distinct().count() == 18
    got = {b: [r[1] for r in rows(w.filter(F.col("batch") == b), "batch", "i", order=["i"])] for b in range(18)}
    assert all(got[b][-1] == got[b + 1][0] for b in range(17)) and got[17][-1] == 120
    assert q.count_windows(sized.range(8).select(F.lit("a").alias("s"), F.col("id").alias("i")), KEY, ["i"]).select("batch").distinct().count() == 1


def test_ordered_distinct(sized):
    d = sized.createDataFrame([("a", i, v) for i, v in enumerate("cabca")], "s string, i int, v string")
    assert rows(q.ordered_distinct(d, KEY, ["i"], "v"), "pos", "v") == [(1, "c"), (2, "a"), (3, "b")]


def test_median_composite_truncates(spark):
    d = spark.createDataFrame([("v", [1, 10]), ("v", [2, 20])], "k string, r array<int>")
    assert rows(q.median_composite(d, ["k"], "r"), "r") == [([1, 15],)]


def test_view_sample_is_stable_and_limited(spark):
    d = spark.range(100).select(F.lit("a").alias("s"), F.lit(1).alias("v"), F.col("id"))
    a = rows(q.view_sample(d, KEY, ["v"], ["id"]), "id")
    assert len(a) == 9 and a == rows(q.view_sample(d.repartition(7), KEY, ["v"], ["id"]), "id")


def test_panels_join_at_the_last_common_boundary(sized):
    text = "abcdefghijklmnopqrstuvwxyz"
    d = sized.createDataFrame([("a", 0, list(text[:12]), [2, 7, 9]), ("a", 1, list(text[5:17]), [2, 4, 8]), ("a", 2, list("zzzzzzzzzzzz"), [3])],
                              "s string, p int, cells array<string>, b array<int>")
    out = rows(q.join_overlapping_panels(d, KEY, ["p"], "cells", "b"), "p", "shift", "cut_left", "cut_right", "joined")
    assert out == [(0, None, None, None, False), (1, 5, 9, 4, True), (2, None, None, None, False)]


def test_windows_as_a_table_function(spark):
    from obsflow.functions import tables
    tables.register(spark)
    d = spark.range(30).select(F.lit("a").alias("s"), F.col("id").alias("i"))
    want = rows(q.count_windows(d, KEY, ["i"], 8, 1).select("i", "batch", "pos"))
    d.createOrReplaceTempView("items")
    assert rows(spark.sql("SELECT i, w.batch, w.pos FROM items, LATERAL explode_windows(i, 30, 8, 1) w")) == want
