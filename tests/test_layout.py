import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

import __spark_entry__ as entry
from obsflow.operators import account as a
from obsflow.operators import edits as e
from obsflow.operators import layout as y
from obsflow.operators import pieces

KEY = ["k"]


def items(spark, lines, per=3, **extra):
    data = [("k", l * 10 + i, l, extra.get("included", {}).get(l, True), extra.get("override", {}).get((l, i), 0), extra.get("measured", {}).get(l, True), 1.0)
            for l in range(lines) for i in range(per)]
    return spark.createDataFrame(data, "k string, pos0 int, line int, inc boolean, ov int, ms boolean, w double")


def reflow(spark, d, target):
    return y.reflow_rows(d, KEY, ["pos0"], target, included=F.col("inc"), measured=F.col("ms"), override=F.col("ov"))


def sizes(out):
    return [n for _, n in rows(out.groupBy("row").agg(F.count("*").alias("n")))]


def test_rows_of_a_target(sized):
    d = items(sized, 5)
    out = reflow(sized, d, 6)
    assert sizes(out) == [6, 6, 3] and sizes(reflow(sized, d, 4)) == [4, 4, 4, 3]
    r = out.groupBy("k", "row").agg(F.sum("w").alias("w"), F.count("*").alias("bars"), F.max("row_target").alias("tg"))
    assert [x for _, x in rows(y.row_width_fraction(r, KEY, "row", "w", "bars", "tg", 6), "row", "width_fraction")] == [1.0, 1.0, 0.5]


def test_an_override_starts_its_own_row(sized):
    d = items(sized, 6, override={(2, 0): 3})
    out = reflow(sized, d, 6)
    assert sizes(out) == [6, 3, 6, 3]
    r = out.groupBy("k", "row").agg(F.sum("w").alias("w"), F.count("*").alias("bars"), F.max("row_target").alias("tg"))
    assert [x for _, x in rows(y.row_width_fraction(r, KEY, "row", "w", "bars", "tg", 6), "row", "width_fraction")] == [1.0, 1.0, 1.0, 0.5]


def test_excluded_lines_are_skipped_and_unmeasured_stand_alone(sized):
    assert sizes(reflow(sized, items(sized, 3, included={1: False}), 6)) == [6]
    d = items(sized, 3, measured={1: False}).filter("line <> 1 or pos0 = 10")
    assert rows(reflow(sized, d, 6).filter("line = 1"), "row", "pos", "row_target") == [(2, 1, 0)]


def bars(spark, n, rests=(), ends=(), multirest=None):
    return spark.createDataFrame([("k", i, "4/4", i in rests, i in ends, (multirest or {}).get(i, 0)) for i in range(1, n + 1)],
                                 "k string, n int, m string, rest boolean, en boolean, mr int")


def none(spark):
    return spark.createDataFrame([], "k string, grp int, n int")


def slots(spark, b, g, per_line=0, source=4):
    out = y.printed_slots(b, g, KEY, "n", "en", None, per_line, source)
    got = {}
    for row, first, last in rows(out, "row", "first", "last"):
        got.setdefault(row, []).append((first, last))
    return got


def test_merged_rests_are_one_slot(sized):
    b = bars(sized, 121, rests=(116, 117))
    want = sized.createDataFrame([("k", 1, 116), ("k", 1, 117)], "k string, grp int, n int")
    g = y.merge_rest_runs(b, want, KEY, "n", "m", "rest", "mr")
    got = slots(sized, b, g.filter("error is null"), per_line=4)
    assert got[29] == [(113, 113), (114, 114), (115, 115), (116, 117)] and got[30] == [(n, n) for n in range(118, 122)]
    assert sum(l - f + 1 for r in got.values() for f, l in r) == 121
    bad = y.merge_rest_runs(bars(sized, 121, rests=(116,)), want, KEY, "n", "m", "rest", "mr")
    assert rows(bad, "error") == [("not a verified rest",)]


def test_rows_follow_the_source(sized):
    b = bars(sized, 10, ends=(3, 7))
    g = y.merge_rest_runs(b, none(sized), KEY, "n", "m", "rest")
    assert [len(r) for r in slots(sized, b, g).values()] == [3, 4, 3]
    assert [len(r) for r in slots(sized, b, g, per_line=4).values()] == [4, 4, 2]
    assert [len(r) for r in slots(sized, bars(sized, 10), g, source=5).values()] == [5, 5]


def test_printed_and_automatic_rest_blocks(sized):
    rests = (*range(1, 9), 10, 11)
    b = bars(sized, 12, rests, multirest={1: 8})
    found = lambda m: [tuple(x) for x in rows(y.merge_rest_runs(b, none(sized), KEY, "n", "m", "rest", m), "first", "last")]
    assert found("mr") == [(1, 8)] and found(None) == [(1, 8), (10, 11)]
    noisy = bars(sized, 12, [r for r in rests if r != 4], multirest={1: 8})
    assert rows(y.merge_rest_runs(noisy, none(sized), KEY, "n", "m", "rest", "mr")) == []


def test_regroup(sized):
    seq = [8, 9, 10, 1, 2, 3, 1, 2, 3]
    d = sized.createDataFrame([("k", i, n, False) for i, n in enumerate(seq)], "k string, i int, n int, en boolean")
    got = {}
    for row, i, n in rows(y.regroup_kept(d, KEY, ["i"], "en", 4), "row", "i", "n"):
        got.setdefault(row, []).append(n)
    assert list(got.values()) == [[8, 9, 10, 1], [2, 3, 1, 2], [3]]


def test_pages(sized):
    page = {"width": 100.0, "height": 220.0, "top": 10.0, "floor": 10.0, "gap": 5.0, "reserve": 50.0}
    d = sized.createDataFrame([("k", i, 100.0, h) for i, h in enumerate([60.0, 60.0, 60.0, 900.0])], "k string, i int, w double, h double")
    out = rows(y.page_pack(d, KEY, ["i"], "w", "h", page), "i", "page", "y", "draw_h")
    assert [(r[1], r[2]) for r in out[:3]] == [(1, 160.0), (1, 95.0), (2, 210.0)] and out[3][1] == 3 and out[3][3] == pytest.approx(150)


def test_wrap_keeps_every_character(sized):
    words = ["one", "two", "averyveryverylongword", "x", "yz"]
    d = sized.createDataFrame([("k", i, w) for i, w in enumerate(words)], "k string, i int, w string")
    out = rows(y.greedy_wrap(d, KEY, "i", "w", 1.0, 10.0, pad=2.0), "row", "pos", "at", "piece")
    assert "".join(p for *_, p in out) == "".join(words)
    assert [p for r, _, _, p in out if r == 1] == ["one", "two"]
    assert all(sum(len(p) + 2 for r, _, _, p in out if r == n) <= 10 for n in {r for r, *_ in out})


@pytest.mark.parametrize("budget, pad", [(10.0, 2.0), (3.0, 4.0)])
def test_wrap_of_whole_lines_is_the_wrap_of_their_tokens(spark, budget, pad):
    words = ["", "a", "bé", "ccc", "𝄞" * 9, "dddd", None, "x" * 30, "e" * 8]
    data = [(k, [words[(k * 7 + i * i + i // 3) % 9] for i in range(n)]) for k, n in enumerate([0, 1, 2, 9, 40, 3, 200, 1, 1, 66_000])] + [(99, None)]
    lines = spark.createDataFrame(data, "k int, ws array<string>")
    tokens = lines.select("k", F.posexplode("ws").alias("i", "w"))
    cols = ["k", "row", "pos", "piece"]
    want = rows(y.greedy_wrap(tokens, KEY, "i", "w", 1.0, budget, pad), "at", *cols)
    assert rows(y.greedy_wrap_lines(lines, KEY, "ws", 1.0, budget, pad), "at", *cols) == want and len(want) > 40_000


def test_lines_are_wrapped_where_they_are_read(spark):
    plan = entry.queries()["greedy_wrap"](spark, entry.SMOKE)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


def test_rhythm(spark):
    d = spark.createDataFrame([(x,) for x in (4.0, 1.5, 0.875, 1 / 3, 0.3)], "d double")
    got = {round(x, 3): r for x, r in rows(d.select("d", y.rhythm_class(F.col("d")).alias("r")))}
    assert tuple(got[4.0]) == ("whole", 0, False) and tuple(got[1.5]) == ("quarter", 1, False) and tuple(got[0.875]) == ("eighth", 2, False)
    assert tuple(got[0.333]) == ("eighth", 0, True) and got[0.3] is None


def test_cost_and_budget(spark):
    rate = spark.createDataFrame([("m", 0.10, 0.01, 0.50), ("dear", 15.0, 1.5, 75.0)], "model string, r_in double, r_cached double, r_out double")
    req = lambda model: spark.createDataFrame([("j", 1, model, 1000, 500, 200, False, 1000, 0)],
                                              "k string, seq int, model string, input_tokens long, cached_input_tokens long, output_tokens long, subscription boolean, prompt_chars long, images int")
    assert rows(a.usage_cost(req("m"), rate, KEY, "model"), "usd")[0][0] == pytest.approx(0.000155)
    assert rows(a.budget_guard(req("dear"), rate, KEY, ["seq"], "model", 0.01), "allowed") == [(False,)]
    assert rows(a.usage_cost(req("odd"), rate, KEY, "model"), "usd", "errors") == [(0.0, 1)]


def test_budget_stops_for_good(sized):
    rate = sized.createDataFrame([("m", 1.0, 1.0, 1.0)], "model string, r_in double, r_cached double, r_out double")
    d = sized.createDataFrame([("j", i, "m", 400_000, 0, 0, False, n, 0) for i, n in enumerate([0, 0, 900_000, 0])],
                              "k string, seq int, model string, input_tokens long, cached_input_tokens long, output_tokens long, subscription boolean, prompt_chars long, images int")
    assert rows(a.budget_guard(d, rate, KEY, ["seq"], "model", 1.2, max_output=0), "seq", "allowed") == [(0, True), (1, True), (2, False), (3, False)]


def edit(spark, times, ops):
    lines = spark.createDataFrame([("k", i, t) for i, t in enumerate(times)], "k string, i int, t int")
    log = spark.createDataFrame([("k", s, op, ix, d, inc) for s, (op, ix, d, inc) in enumerate(ops)], "k string, s int, op string, index int, direction int, included boolean")
    out = e.replay_edits(lines, log, KEY, ["i"], "t", ["s"])
    return [r[1] for r in rows(out.filter("kind = 'line'"), "seq", "line")], out.filter("kind = 'rejected'").count()


def test_replay(sized):
    op = lambda name, i=None, d=None, inc=None: (name, i, d, inc)
    assert edit(sized, [4, 42, 59], [op("duplicate", 1), op("remove", 2), op("undo")]) == ([4, 42, 42, 59], 0)
    assert edit(sized, [0, 1, 2], [op("remove", 1), op("remove", 1), op("undo"), op("undo")]) == ([0, 1, 2], 0)
    assert edit(sized, [0, 1], [op("remove", -1), op("undo"), op("move", 0, 1), op("move", 1, 1)]) == ([1, 0], 2)


def test_edit_state(spark):
    lines = spark.createDataFrame([("k", 0, [0.0, 0.0, 1.0, 1.0]), ("k", 1, [0.0, 0.0, 1.0, 1.0])], "k string, line int, crop array<double>")
    log = spark.createDataFrame([("k", 0, 1, [0.0, 0.0, 0.5, 0.5], False, 1.5, False), ("k", 0, 2, None, False, 0.5, True), ("k", 1, 3, [0.0, 0.0, 0.01, 0.5], False, 2.0, False),
                                 ("k", 0, 4, None, False, 9.0, False)], "k string, line int, seq int, crop array<double>, reset boolean, height_scale double, all_heights boolean")
    assert rows(e.edit_state(lines, log, KEY, "line", "seq", F.lit(100), F.lit(100)), "line", "crop", "height_scale") == [(0, [0.0, 0.0, 0.5, 0.5], 0.5), (1, [0.0, 0.0, 1.0, 1.0], 0.5)]
    back = log.unionByName(spark.createDataFrame([("k", 0, 5, None, True, None, False)], log.schema))
    assert rows(e.edit_state(lines, back, KEY, "line", "seq", F.lit(100), F.lit(100)), "line", "crop", "height_scale")[0] == (0, [0.0, 0.0, 1.0, 1.0], 1.0)


def test_excluded_lines_remember_their_place(sized):
    d = sized.createDataFrame([("k", i, i not in (1, 2)) for i in range(4)], "k string, i int, inc boolean")
    assert rows(e.hide_excluded(d, KEY, ["i"], "inc"), "i", "visible", "index") == [(0, True, 0), (1, False, 1), (2, False, 1), (3, True, 1)]


def test_moves(sized):
    lines = sized.createDataFrame([("k", i) for i in (1, 2, 3)], "k string, line int")
    mv = lambda *m: sized.createDataFrame([("k", i, *x) for i, x in enumerate(m)], "k string, o int, line int, before int")
    order = lambda m: [r[1] for r in rows(e.move_before(lines, m, KEY, "line", "line", "before", "o"), "seq", "line")]
    assert order(mv((3, 1))) == [3, 1, 2] and order(mv((1, 0))) == [2, 3, 1] and order(mv((1, 0), (9, 1))) == [1, 2, 3]


def test_runs_of_positions_against_plain_lists():
    for seed in range(150):
        rnd = random.Random(seed)
        n = rnd.randrange(0, 12)
        table, plain = pieces.PieceTable(n), [(i, 0) for i in range(n)]
        for _ in range(50):
            k = rnd.random()
            if plain and k < 0.4:
                i = rnd.randrange(len(plain))
                assert table.remove(i) == plain.pop(i)
            elif k < 0.8:
                i, item = rnd.randrange(len(plain) + 1), (rnd.randrange(12), rnd.randrange(3))
                table.insert(i, item)
                plain.insert(i, item)
            elif plain:
                i = rnd.randrange(len(plain))
                assert table.get(i) == plain[i]
        assert [(f + j, m) for _, first, size, mark in table.runs() for f, s, m in zip(first, size, mark) for j in range(s)] == plain
        n = rnd.randrange(1, 9)
        moved, plain = pieces.MovedRuns(n), list(range(n))
        for _ in range(20):
            a = rnd.randrange(n)
            b = rnd.choice([None, *(x for x in range(n) if x != a)])
            moved.move(a, b)
            plain.remove(a)
            plain.insert(len(plain) if b is None else plain.index(b), a)
        assert [f + j for f, s in moved.runs() for j in range(s)] == plain


def test_many_edits_of_many_lines(spark, monkeypatch):
    monkeypatch.setattr(pieces, "RUNS", 16)
    rnd, n = random.Random(4), 20_000
    lines = spark.range(n).select(F.lit("k").alias("k"), F.col("id").alias("i"), (F.col("id") * 3).alias("t"))
    plain, log = list(range(0, 3 * n, 3)), []
    for s in range(3000):
        i = rnd.randrange(len(plain))
        if s % 3:
            log.append(("k", s, "remove", i, None, None))
            plain.pop(i)
        else:
            log.append(("k", s, "duplicate", i, None, None))
            plain.insert(i + 1, plain[i])
    out = e.replay_edits(lines, spark.createDataFrame(log, "k string, s int, op string, index int, direction int, included boolean"), KEY, ["i"], "t", ["s"])
    assert [r.line for r in out.orderBy("seq").collect()] == plain


def test_replayed_marks_and_projects_without_a_log(spark):
    lines = spark.createDataFrame([(k, i, i) for k in ("a", None) for i in range(3)], "k string, i int, t int")
    log = spark.createDataFrame([("a", 1, "include", 1, None, False), ("a", 2, "remove", 1, None, None), ("a", 3, "undo", None, None, None), ("a", 4, "include", 2, None, None), ("x", 5, "remove", 0, None, None)],
                                "k string, s int, op string, index int, direction int, included boolean")
    got = sorted(map(tuple, e.replay_edits(lines, log, KEY, ["i"], "t", ["s"]).collect()), key=str)
    want = [("a", "line", 0, 0, True), ("a", "line", 1, 1, False), ("a", "line", 2, 2, None), *[(None, "line", i, i, True) for i in range(3)], ("x", "rejected", 5, None, None)]
    assert got == sorted(want, key=str)
