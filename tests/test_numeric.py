import math
import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from obsflow.operators import bands as b
from obsflow.operators import diff as d
from obsflow.operators import numbered as n
from obsflow.operators import rules as p
from obsflow.operators import timeseries as t

KEY = ["k"]


def boundaries(spark, labels, xs=None):
    xs = xs or [40 + 210 * i for i in range(len(labels))]
    return spark.createDataFrame([("k", i, float(x), l) for i, (x, l) in enumerate(zip(xs, labels))], "k string, i int, x double, label int")


def test_labels_number_boundaries(sized):
    got = rows(n.verify_numbering(boundaries(sized, [10, None, None, 13, 14, 15]), KEY, ["i"], "x", "label"), "x", "number")
    assert got == [(40.0 + 210 * i, 10 + i) for i in range(6)]


def test_known_width_restores_a_hidden_boundary(sized):
    hidden = boundaries(sized, [10, 12, 13], [40, 460, 670])
    assert rows(n.verify_numbering(hidden, KEY, ["i"], "x", "label"), "x", "number")[0] == (40.0, None)
    w = sized.createDataFrame([(10, 210.0)], "number int, width double")
    got = rows(n.verify_numbering(hidden, KEY, ["i"], "x", "label", w), "x", "number", "inferred")
    assert got[:3] == [(40.0, 10, False), (250.0, 11, True), (460.0, 12, False)]


def test_numbers_spread_along_known_widths(sized):
    w = sized.createDataFrame([(i, 210.0) for i in range(9, 15)], "number int, width double")
    out = n.propagate_by_width(boundaries(sized, [None, None, 12, None, None]).withColumn("label", F.col("label").cast("long")), KEY, "x", "label", w, [])
    assert [r[1] for r in rows(out, "x", "label")] == [10, 11, 12, 13, 14]


def test_width_consensus_compares_with_the_first(sized):
    data = [("k", 1, i, w) for i, w in enumerate([100.0, 103.0, 106.0, 106.0, 109.0])]
    c = n.width_consensus(sized.createDataFrame(data, "k string, n int, i int, w double"), KEY, "n", "w", ["i"])
    # 103 joins 100; 106 is too far from 100 and opens its own cluster, which 109 joins.
    assert rows(c, "width", "count", "trusted") == [(106.0, 3, True)]


def test_backward_reset(sized):
    frames = sized.createDataFrame([("k", 1, [30, 31]), ("k", 2, []), ("k", 3, [10, 11]), ("j", 1, [1, 2]), ("j", 2, [2, 3])], "k string, t int, n array<int>")
    assert rows(n.backward_reset(frames, KEY, ["t"], "n")) == [("j", False), ("k", True)]


def test_votes(spark):
    def cell(states):
        data = [("k", "c", i * 0.5, vis, ink) for i, (vis, ink) in enumerate(states)]
        df = spark.createDataFrame(data, "k string, cell string, t double, vis boolean, ink boolean")
        return rows(n.vote_transient(df, KEY, "cell", "t", [], F.col("vis"), F.col("ink")), "drop")[0][0]

    assert cell([(True, True)] + [(True, False)] * 5)  # one noisy sample, five clean
    assert not cell([(True, True)] * 3 + [(False, False)] * 7)  # bright samples do not vote


def test_gaps_and_rows(sized):
    nums = [1, 2, 3, 4, 5, 7, 8, 9, 10]
    df = sized.createDataFrame([("k", x, 10.0) for x in nums], "k string, n int, w double")
    assert rows(n.gap_report(df, KEY, "n"), "missing", "declined") == [(6, False)]
    assert rows(n.gap_report(df.filter("n > 5"), KEY, "n"), "missing", "declined") == [(None, True)]
    assert [r[1] for r in rows(n.group_consecutive(df, KEY, "n", "w"), "row", "numbers")] == [[1, 2, 3, 4], [5], [7, 8, 9, 10]]


def timed(spark, durations, bars=None, bpm=120.0, beats=4.0):
    data, at = [], 0.0
    for i, s in enumerate(durations):
        data.append(("k", i, at, at + s, 2 if s == 4 else 4))
        at += s
    df = spark.createDataFrame(data, "k string, i int, t double, until double, bars int")
    return rows(t.timed_repeats(df, KEY, ["i"], "t", "until", "bars", bpm, beats, 0.5), "t", "copy", "until", "i", "bars", "k")


SHOWN = [12, 8, 8, 8, 16, 4, 8, 8, 20]


def test_repeat_by_timing(sized):
    got = timed(sized, SHOWN)
    assert [r[0] for r in got] == [0, 12, 20, 28, 36, 44, 52, 56, 64, 72] and sum(r[1] for r in got) == 1
    # A second pass over its own output adds nothing.
    df = sized.createDataFrame([("k", i, r[0], r[2], r[4]) for i, r in enumerate(got)], "k string, i int, t double, until double, bars int")
    assert t.timed_repeats(df, KEY, ["i"], "t", "until", "bars", 120.0, 4.0, 0.5).filter("copy > 0").count() == 0


@pytest.mark.parametrize("bpm,beats", [(60, 4), (240, 4), (120, 3), (150, 4)])
def test_wrong_tempo_adds_nothing(spark, bpm, beats):
    assert sum(r[1] for r in timed(spark, SHOWN, bpm=bpm, beats=beats)) == 0


def test_three_passes_add_two(spark):
    assert len([r for r in timed(spark, [12, 8, 8, 8, 24, 4, 8, 8, 20]) if r[1] > 0]) == 2


@pytest.mark.parametrize("bpm", [83, 113, 157])
def test_tempo_of_clicks(spark, bpm):
    rnd = random.Random(1)
    rate = 11025
    x = [rnd.gauss(0, 0.001) for _ in range(rate * 12)]
    step = 60 * rate / bpm
    k = 0
    while int(k * step) + 400 < len(x):
        for j in range(400):
            x[int(k * step) + j] += math.exp(-j / 60) * math.sin(j * 0.7)
        k += 1
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate(x)], "k string, i long, x double")
    flux = t.spectral_onset(df, KEY, "i", "x")
    o = t.onset_strength(flux.select("k", F.col("frame").alias("i"), F.col("flux").alias("x")), KEY, "i", "x")
    s = t.period_score(t.autocorrelation(o, KEY, "i", "onset", 265), KEY, 60 * rate / 128)
    out = rows(t.segment_consensus(s.withColumn("seg", F.lit(1)), KEY, "seg"), "bpm", "consistent")
    assert abs(out[0][0] - bpm) <= 1 and out[0][1]


def test_silence_has_no_tempo(spark):
    o = spark.range(300).select(F.lit("k").alias("k"), F.col("id").alias("i"), F.lit(0.0).alias("onset"))
    s = t.period_score(t.autocorrelation(o, KEY, "i", "onset", 73), KEY, 1440.0)
    assert t.segment_consensus(s.withColumn("seg", F.lit(1)), KEY, "seg").count() == 0


def test_clock_stops_only_when_work_has_finished(sized):
    log = sized.createDataFrame([("k", i, float(ts), op) for i, (ts, op) in enumerate([(0, "begin"), (2, "pause"), (5, "end"), (9, "resume"), (10, "note")])], "k string, i int, ts double, op string")
    assert rows(t.net_active_time(log, KEY, ["i"], "ts", "op"), "active_s", "paused_s") == [(6.0, 4.0)]


def test_playback(sized):
    log = sized.createDataFrame([("k", i, float(ts), op, v) for i, (ts, op, v) in enumerate([(0, "play", None), (3, "speed", 2.0), (5, "pause", None), (9, "seek", 99.0), (10, "play", None), (11, "note", None)])],
                                "k string, i int, ts double, op string, v double")
    assert [r[1] for r in rows(t.playback_position(log, KEY, ["i"], "ts", "op", "v", 10.0), "i", "position")] == [0.0, 3.0, 7.0, 10.0, 0.0, 2.0]


def test_cuts_rebuild_the_width(sized):
    df = sized.createDataFrame([("k", x) for x in (10, 210, 410, 595)] + [("j", 300), ("j", 310)], "k string, x int")
    got = rows(b.partition_cuts(df, KEY, "x", 600.0, 10.0))
    assert got[0][:2] == ("j", None) and got[0][3]
    cuts = [(l, r) for k, l, r, _ in got if k == "k"]
    assert cuts == [(0.0, 210.0), (210.0, 410.0), (410.0, 600.0)]


def test_runs_and_close_boundaries(sized):
    df = sized.createDataFrame([("k", i) for i in (1, 2, 3, 7, 8, 10)], "k string, i int")
    assert rows(b.runs(df, KEY, "i"), "first", "last", "n") == [(1, 3, 3), (7, 8, 2), (10, 10, 1)]
    x = sized.createDataFrame([("k", v) for v in (0.0, 4.0, 8.0, 20.0)], "k string, x double")
    assert rows(b.merge_close(x, KEY, ["x"], "x", 5.0), "x") == [(8.0,), (20.0,)]
    assert rows(b.merge_close(x, KEY, ["x"], "x", 5.0, keep="first"), "x") == [(0.0,), (8.0,), (20.0,)]


def test_difference_tolerates_one_cell(spark):
    w = h = 12
    base = [1 if 3 <= x < 7 and 3 <= y < 7 else 0 for y in range(h) for x in range(w)]
    moved = [1 if 4 <= x < 8 and 3 <= y < 7 else 0 for y in range(h) for x in range(w)]
    gone = [0] * (w * h)
    df = spark.createDataFrame([("same", base, base), ("moved", base, moved), ("gone", base, gone), ("shape", base, base[1:])], "k string, a array<int>, b array<int>")
    got = dict(rows(d.tolerant_difference(df, "a", "b", w, h), "k", "diff"))
    assert got["same"] == got["moved"] == 0 and got["gone"] == 1.0 and got["shape"] == 1.0


def _grow(a: np.ndarray) -> np.ndarray:
    p = np.pad(a, 1)
    h, w = a.shape
    return np.max([p[y : y + h, x : x + w] for y in range(3) for x in range(3)], axis=0)


def _specks(changed: np.ndarray, fine: bool) -> np.ndarray:
    """Remove specks: cells outside any full 2x2 block, or (fine) in groups of fewer than three."""
    h, w = changed.shape
    p = np.pad(changed, 1)
    if fine:
        around = sum(p[y : y + h, x : x + w] for y in range(3) for x in range(3)) - changed
        around = around * changed
        linked = _grow((around >= 2).astype(changed.dtype))
        return changed * ((around >= 2) | (linked > 0))
    block = p[:-1, :-1] & p[1:, :-1] & p[:-1, 1:] & p[1:, 1:]
    return block[:-1, :-1] | block[1:, :-1] | block[:-1, 1:] | block[1:, 1:]


def raster_difference(a, b, w: int, h: int, fine: bool) -> float:
    """Share of ink that has no counterpart within one cell; the worst inked tile counts alone."""
    if a is None or b is None or len(a) != w * h or len(b) != w * h:
        return 1.0
    a, b = np.asarray(a, np.int32).reshape(h, w), np.asarray(b, np.int32).reshape(h, w)
    changed = _specks((a & (1 - _grow(b))) | (b & (1 - _grow(a))), fine)
    score = changed.sum() / max(1, a.sum() + b.sum())
    wide = 100 if fine else 150
    for y in range(0, h, 100):
        for x in range(0, w, wide):
            ink = a[y : y + 100, x : x + wide].sum() + b[y : y + 100, x : x + wide].sum()
            if ink >= 100:
                score = max(score, changed[y : y + 100, x : x + wide].sum() / ink)
    return float(min(1.0, score * 2) if fine else score)


@pytest.mark.parametrize(("w", "h", "fine"), [(8, 8, False), (8, 8, True), (130, 7, False), (130, 7, True), (310, 120, False), (210, 105, True)])
def test_bit_planes_against_plain_rasters(spark, w, h, fine):
    rnd = random.Random(w + fine)
    pairs = []
    for k in range(6):
        share = rnd.choice([0.02, 0.1, 0.5])
        p = [int(rnd.random() < share) for _ in range(w * h)]
        q = [int(v if rnd.random() < 0.9 else rnd.random() < share) for v in p[1:] + p[:1]]
        pairs.append((k, p, q))
    pairs += [(90, None, pairs[0][1]), (91, pairs[0][1][1:], pairs[0][1]), (92, [1] * (w * h), [0] * (w * h))]
    out = d.tolerant_difference(spark.createDataFrame(pairs, "k int, a array<int>, b array<int>"), "a", "b", w, h, fine)
    assert "ArrowEvalPython" not in out._jdf.queryExecution().executedPlan().toString()
    got = dict(rows(out, "k", "diff"))
    for k, p, q in pairs:
        assert got[k] == pytest.approx(raster_difference(p, q, w, h, fine), abs=1e-12), k


def test_prototypes_in_many_blocks(spark):
    rnd = random.Random(2)
    protos = [(i % 5, [rnd.random() for _ in range(4)]) for i in range(700)]
    data = [(i, [rnd.random() for _ in range(4)]) for i in range(60)]
    pf = spark.createDataFrame(protos, "label int, p array<double>")
    df = spark.createDataFrame(data, "id int, v array<double>")
    got = {r[0]: r[1:] for r in rows(d.nearest_prototype(df, ["id"], "v", pf, "label", "p", max_err=0.5, margin=0.01), "id", "label", "err")}
    for i, v in data:
        per = {}
        for l, q in protos:
            per[l] = min(per.get(l, 9), sum(abs(a - b) for a, b in zip(v, q)) / 4)
        (e1, l1), (e2, _) = sorted((e, l) for l, e in per.items())[:2]
        assert got[i][1] == pytest.approx(e1) and got[i][0] == (l1 if e2 - e1 >= 0.01 else None)


def test_few_of_many_prototypes_are_compared(spark):
    rnd = random.Random(7)
    # Classes around centres, as templates of one class are.
    centres = [[rnd.random() for _ in range(6)] for _ in range(40)]
    near = lambda c: [x + rnd.gauss(0, 0.02) for x in c]
    protos = [(i % 40, near(centres[i % 40])) for i in range(10_000)]
    data = [(i, near(centres[i % 40])) for i in range(60)] + [(90, None), (91, [0.5] * 3)]
    pf = spark.createDataFrame(protos, "label int, p array<double>")
    df = spark.createDataFrame(data, "id int, v array<double>")
    compared = d.prototype_candidates(df, ["id"], "v", pf, "label", "p", 0.01, 0.02).count()
    assert compared < 60 * 10_000 / 10
    got = {r[0]: r[1:] for r in rows(d.nearest_prototype(df, ["id"], "v", pf, "label", "p", margin=0.01), "id", "label", "err")}
    templates = np.array([p for _, p in protos])
    for i, v in data[:60]:
        errors = np.abs(templates - v).mean(axis=1)
        per = sorted((errors[k::40].min(), k) for k in range(40))
        assert got[i][1] == pytest.approx(per[0][0]) and got[i][0] == (per[0][1] if per[0][0] <= 0.29 and per[1][0] - per[0][0] >= 0.01 else None)
    assert got[90] == (None, None) and got[91] == (None, None)


def test_numbers_keep_identical_rows_apart(spark):
    df = spark.createDataFrame([(9, 17), (9, 9), (None, 9)], "a int, b int")
    assert [r[0] for r in df.select(d.numbered_identity(F.col("a"), F.col("b"), F.lit(0.0))).collect()] == [1.0, 0.0, 0.0]


def test_lifted_marks(spark):
    cases = {"A tempo quarter=110": (110, "A", ""), "C ♩=144": (144, "C", ""), "B": (0, "B", ""), "A tempo": (0, "", "A tempo"), "cresc.": (0, "", "cresc.")}
    df = spark.createDataFrame([(m, [(0.0, m)]) for m in cases], "m string, e array<struct<onset:double,marks:string>>")
    out = df.select("m", p.lift_marks(F.col("e"), F.lit(0), F.lit("")).alias("r")).select("m", "r.*")
    assert {r[0]: (r[1], r[2], r[3][0]) for r in out.collect()} == cases


def test_video_links(spark):
    ok = ["https://youtu.be/abcdefghijk?t=3", "http://www.youtube.com/watch?v=abcdefghijk&list=x", "https://m.youtube.com/shorts/abcdefghijk", " https://youtube.com/embed/abcdefghijk "]
    bad = ["https://example.com/watch?v=abcdefghijk", "https://www.youtube.com/playlist?list=abc", "file:///tmp/a.mp4", "ftp://youtu.be/abcdefghijk", "https://youtu.be/short", ""]
    out = rows(p.canonical_video_url(spark.createDataFrame([(u,) for u in ok + bad], "u string"), "u"), "u", "canonical")
    assert {u: c for u, c in out} == {**{u: p.CANONICAL + "abcdefghijk" for u in ok}, **{u: None for u in bad}}


def test_invalid_values(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(0, None, 4.0), (1, nan, 4.0), (2, 120.0, inf), (3, 301.0, 4.0), (4, 120.0, 0.0), (5, 120.0, 4.0)], "i int, bpm double, beats double")
    assert [r[0] for r in rows(p.range_rules(df, ["i"], ["bpm", "beats"]), "i")] == [0, 1, 2, 3, 4]
    bars = spark.createDataFrame([(0, 3.0), (1, 17.0), (2, 6.5), (3, nan), (4, None), (5, 6.0)], "i int, bars_per_line double")
    assert [r[0] for r in rows(p.range_rules(bars, ["i"], ["bars_per_line"]), "i")] == [0, 1, 2, 3, 4]
    crops = spark.createDataFrame([(0, 0.5, 0.1, 0.2, 0.9), (1, -0.1, 0.0, 1.0, 1.0), (2, nan, 0.0, 1.0, 1.0), (3, 0.0, 0.0, 1.0, 1.0)], "i int, l double, t double, r double, b double")
    box = p.crop_box([F.col(c) for c in "ltrb"], F.lit(640), F.lit(360))
    assert [r[0] for r in rows(crops.select("i", box.alias("x")).filter("x is not null"), "i")] == [3]


def test_file_names(spark):
    cases = {"a/b:c?.": "a_b_c_", " .. ": "Sheet music", "con.txt": "_con.txt", "x" * 120: "x" * 100, "Console": "Console"}
    out = spark.createDataFrame([(c,) for c in cases], "c string").select("c", p.safe_name(F.col("c")).alias("n"))
    assert dict(rows(out)) == cases


def test_schema_paths(spark):
    schema = {"type": "object", "properties": {"n": {"type": "integer"}, "x": {"type": "array", "items": {"type": "object", "properties": {"b": {"type": "boolean"}}}}}}
    docs = ['{"n": 1, "x": [{"b": true}]}', '{"n": true, "x": [{"b": 1}, {}]}', "{", '{"n": 1, "x": []}']
    df = spark.createDataFrame(list(enumerate(docs)), "i int, j string")
    assert rows(p.schema_check(df, ["i"], "j", schema)) == [
        (1, "response.n", "expected integer"), (1, "response.x[0].b", "expected boolean"), (1, "response.x[1]", "missing or unexpected fields"), (2, "response", "malformed")]


def grids_by_rule(rows, n):
    """Regular grids by trying every position again, over (position, strength) of one key."""
    xs = [x for x, _ in rows]
    power = dict(rows)
    near = lambda at: min(xs, key=lambda y: abs(y - at))
    out, i = [], 0
    while i + n - 1 < len(xs):
        hit = None
        for last in xs[i + n - 1:]:
            gap = (last - xs[i]) / (n - 1)
            tol = max(1.5, gap * 0.12)
            places = [xs[i] + m * gap for m in range(n)]
            if not 3 <= gap <= 35 or any(abs(near(p) - p) > tol for p in places):
                continue
            if n == 4 and any(abs(near(p) - p) <= tol for p in (xs[i] - gap, last + gap)):
                continue
            hit = [near(p) for p in places]
            break
        while hit and n == 6:
            gap = (hit[-1] - hit[0]) / 5
            more = near(hit[-1] + gap)
            if abs(more - hit[-1] - gap) > max(1.5, gap * 0.12) or more == hit[-1] or power[more] <= power[hit[0]] * 1.1:
                break
            hit = [*hit[1:], more]
        if hit:
            out.append((hit[0], hit[-1], (hit[-1] - hit[0]) / (n - 1)))
            i = xs.index(hit[-1]) + 1
        else:
            i += 1
    return out


@pytest.mark.parametrize("n", [4, 6])
def test_regular_grids_tolerate_other_rows(sized, n):
    rnd = random.Random(n)
    data = {}
    for k in range(12):
        xs, at = set(), 0
        for _ in range(5):
            at += rnd.randrange(30, 90)
            gap = rnd.randrange(4, 20)
            xs.update(at + m * gap + rnd.choice([0, 0, 1]) for m in range(rnd.choice([n - 1, n, n, n + 1])))
            xs.update(at + rnd.randrange(n * gap) for _ in range(rnd.choice([0, 1, 2])))
            at = max(xs)
        data[f"k{k}"] = [(float(x), float(rnd.randrange(10, 30))) for x in sorted(xs)]
    d = sized.createDataFrame([(k, x, s) for k, r in data.items() for x, s in r], "k string, x double, s double")
    got = {}
    for k, *g in rows(b.regular_grids(d, ["k"], "x", n, strength="s"), "k", "first", "last", "spacing"):
        got.setdefault(k, []).append(tuple(g))
    assert got == {k: w for k, r in data.items() if (w := grids_by_rule(r, n))} and got
