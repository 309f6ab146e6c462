"""Recovering an exact order from printed numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsflow.functions.exprs import unfold
from obsflow.operators.reconcile import missing_numbers
from obsflow.plans import runtime
from obsflow.plans.ordered import (
    Deal, Fold, Ordered, best, dealt, lag, last_known, lead, next_known, row_number, running_sum,
)


def verify_numbering(df: DataFrame, keys, order: list[str], x: str, label: str, widths: DataFrame | None = None,
                     width_keys: list[str] | None = None, spacing: float = 10.0, frame_width: float = 1000.0,
                     deal: Deal | None = None) -> DataFrame:
    """Numbers of boundaries supported by two printed labels, and boundaries inferred from known widths.

    Labels number what lies between them when their difference equals their distance (at
    most 3).  When boundaries are missing (label difference at most 3), known widths place
    them, provided at most one width is unknown and every visible boundary is explained.
    ``widths``: width_keys, number, width.  ``deal`` where the boundaries are already dealt
    by the keys.
    """
    df, deal = dealt(df, keys, deal)
    o = Ordered(df, keys, order, chunked=deal.chunked).with_columns(i=row_number(), _second=lead(F.col(x).cast("double")))
    pair = F.when(F.col(label).isNotNull(), F.struct(F.col("i").alias("i"), F.col(label).cast("bigint").alias("n"), F.col(x).cast("double").alias("x")))
    o = o.columns(_k=pair)
    o = o.with_columns(_pi=last_known("_k"), _pe=last_known("_k", inclusive=False), _ni=next_known("_k"), _ne=next_known("_k", inclusive=False))

    def agrees(a, b):
        return F.coalesce((b["n"] - a["n"] == b["i"] - a["i"]) & (b["i"] - a["i"] <= 3), F.lit(False))

    known = F.col("_k").isNotNull()
    seen = agrees(F.col("_pe"), F.col("_k")) | agrees(F.col("_k"), F.col("_ne"))
    number = F.when(known, F.when(seen, F.col("_k")["n"])).otherwise(
        F.when(agrees(F.col("_pi"), F.col("_ni")), F.col("_pi")["n"] + F.col("i") - F.col("_pi")["i"]))
    o = o.columns(number=number)
    out = o.result
    plain = out.select(*keys, F.col(x).cast("double").alias("x"), "number", F.lit(False).alias("inferred"))
    if widths is None:
        return plain
    # One row per labelled pair with missing boundaries between.
    a, b = F.col("_k"), F.col("_ne")
    gap = known & (b["i"] - a["i"] >= 1) & (b["i"] - a["i"] < b["n"] - a["n"]) & (b["n"] - a["n"] <= 3)
    wk = width_keys or []
    g = out.filter(gap).select(*keys, a["i"].alias("_i"), b["i"].alias("_j"), a["n"].alias("_n"), b["n"].alias("_nn"), a["x"].alias("_x"), b["x"].alias("_xx"))
    parts = g.withColumn("_num", F.explode(F.sequence(F.col("_n"), F.col("_nn") - 1)))
    wd = widths.select(*wk, F.col("number").cast("bigint").alias("_num"), F.col("width").cast("double").alias("_w"))
    parts = parts.join(runtime.small(wd), [*wk, "_num"], "left")
    # At most three widths per pair come together.
    g = parts.groupBy(*keys, "_i", "_j", "_n", "_nn", "_x", "_xx").agg(
        F.array_sort(F.collect_list(F.struct(F.col("_num").alias("n"), F.col("_w").alias("w")))).alias("_ws"),
        F.count_if(F.col("_w").isNull()).alias("_unknown"), F.coalesce(F.sum("_w"), F.lit(0.0)).alias("_sum"))
    span = F.col("_xx") - F.col("_x")
    rest = span - F.col("_sum")
    ok = (F.col("_unknown") <= 1) & F.when(F.col("_unknown") == 1, (rest > spacing * 3) & (rest < frame_width * 0.65)).otherwise(
        F.abs(F.col("_sum") - span) <= F.greatest(F.lit(4.0), span * 0.02))
    g = g.filter(ok).withColumn("_ws", F.transform("_ws", lambda s: F.struct(s["n"].alias("n"), F.coalesce(s["w"], rest).alias("w"))))
    ahead = lambda m: F.aggregate(F.filter("_ws", lambda s: s["n"] < m), F.lit(0.0), lambda t, s: t + s["w"])
    g = g.withColumn("_at", F.concat(
        F.transform("_ws", lambda s: F.struct(F.rint(F.col("_x") + ahead(s["n"])).alias("p"), s["n"].alias("n"))),
        F.array(F.struct(F.col("_xx").alias("p"), F.col("_nn").alias("n")))))
    # A pair's visible boundaries are its labels and at most one row between; each takes the
    # nearest inferred position.  All of it is known at the row of the first label.
    o = o._same(deal.join(o.df, g.select(*keys, F.col("_i").alias("i"), "_at"), keys, ["i"], "left"))
    o.order, o.moved = ["i"], True
    seen_at = F.when(b["i"] - a["i"] == 2, F.array(a["x"], F.col("_second"), b["x"])).otherwise(F.array(a["x"], b["x"]))
    place = lambda v: F.array_min(F.transform("_at", lambda s: F.struct(F.abs(s["p"] - v).alias("d"), s["n"].alias("n"))))
    o = o.columns(_near=F.when(F.col("_at").isNotNull(), F.transform(seen_at, place)))
    good = F.array_max(F.transform("_near", lambda s: s["d"])) < 4
    o = o.columns(_used=F.when(good, F.transform("_near", lambda s: s["n"])))
    o = o.with_columns(_was=last_known(F.when(known, F.struct("i", "_used")), inclusive=False))
    was = F.col("_was")
    fixed = F.greatest(F.get("_used", F.lit(0)), F.get(was["_used"], (F.col("i") - was["i"]).cast("int")))
    row = lambda at, n, new: F.struct(at.cast("double").alias("x"), n.cast("bigint").alias("number"), F.lit(new).alias("inferred"))
    new = F.transform(F.filter("_at", lambda s: ~F.array_contains("_used", s["n"])), lambda s: row(s["p"], s["n"], True))
    own = F.array(row(F.col(x), F.coalesce(fixed, "number"), False))
    return o.result.select(*keys, unfold(F.when(F.col("_used").isNull(), own).otherwise(F.concat(own, new))).alias("_s")).select(*keys, "_s.*")


def propagate_by_width(df: DataFrame, keys, x: str, number: str, widths: DataFrame, width_keys: list[str], rounds: int | None = None) -> DataFrame:
    """Number a boundary beside a numbered one when the known width between them fits.

    Repeated until nothing changes, or ``rounds`` times.
    """
    wd = widths.select(*width_keys, F.col("number").cast("bigint").alias("_wn"), F.col("width").cast("double").alias("_w"))
    wd = runtime.small(wd)
    cur = df
    o = Ordered(cur, keys, [x])
    done = 0
    while rounds is None or done < rounds:
        done += 1
        d = o.df
        for name, of in (("_own", F.col(number)), ("_prev", F.col(number) - 1)):
            w = wd.withColumnRenamed("_w", name)
            d = d.withColumn("_wn", of.cast("bigint")).join(w, [*width_keys, "_wn"], "left").drop("_wn")
        o = o._same(d).with_columns(_l=lag(F.struct(F.col(x).alias("x"), F.col(number).alias("n"), F.col("_own").alias("w"))),
                                    _r=lead(F.struct(F.col(x).alias("x"), F.col(number).alias("n"), F.col("_prev").alias("w"))))
        l, r = F.col("_l"), F.col("_r")
        fits = lambda gap, w: F.abs(gap - w) <= F.greatest(F.lit(4.0), w * 0.02)
        from_left = F.when(fits(F.col(x) - l["x"], l["w"]), l["n"] + 1)
        from_right = F.when((r["n"] > 1) & fits(r["x"] - F.col(x), r["w"]), r["n"] - 1)
        o = o.columns(_had=F.col(number), **{number: F.coalesce(F.col(number), from_left, from_right)})
        if rounds is None:
            o = o._same(runtime.checkpoint(o.df))
            if o.df.filter(F.col("_had").isNull() & F.col(number).isNotNull()).isEmpty():
                break
        o = o._same(o.df.drop("_own", "_prev", "_l", "_r", "_had"))
    return o._same(o.df.drop("_own", "_prev", "_l", "_r", "_had")).result


def fill_boundaries(df: DataFrame, keys, x: str, number: str, widths: DataFrame, width_keys: list[str], frame: float, *,
                    seen: DataFrame | None = None, double: Column | None = None, opening: Column | None = None, deal: Deal | None = None) -> DataFrame:
    """Further numbers beside verified ones, and boundaries that are not visible.

    An unnumbered boundary beside a numbered one gets its number when that is in ``seen``
    (keys, number) or the boundary is a ``double`` one on its right.  A first boundary that
    ``opening`` marks as the real left end, in the first fifth of the frame and followed by
    2, is 1.  Then each number and the known width beside it place the next boundary: a
    visible one within 4 of that place gets the number, and where none stands between
    them one is inserted (``inferred``), from the left if both sides would.  ``deal`` where
    the boundaries are already dealt by the keys.
    """
    df, deal = dealt(df, keys, deal)
    cur = df.withColumns({"_dbl": F.lit(False) if double is None else F.coalesce(double, F.lit(False)), "_open": F.lit(False) if opening is None else F.coalesce(opening, F.lit(False))})
    o = Ordered(cur, keys, [x], chunked=deal.chunked).with_columns(_rn=row_number(), _l=lag(number), _r=lead(number))
    left, right = F.col("_l") + 1, F.col("_r") - 1
    d = o.columns(_from_l=left, _from_r=right)
    if seen is None:
        in_l = in_r = F.lit(False)
    else:
        known = deal.of(seen.select(*keys, F.col("number").cast("bigint").alias("_sn")), [*keys, "_sn"]).distinct()
        known = known if deal.parts else runtime.small(known)
        for side in ("l", "r"):
            mark = known.withColumnsRenamed({"_sn": f"_from_{side}"}).withColumn(f"_seen_{side}", F.lit(True))
            d = d._same(deal.of(d.df, [*keys, f"_from_{side}"]).join(mark, [*keys, f"_from_{side}"], "left"))
        d = d._same(deal.of(d.df, keys))
        in_l, in_r = F.coalesce("_seen_l", F.lit(False)), F.coalesce("_seen_r", F.lit(False))
    first = (F.col("_rn") == 1) & (F.col("_r") == 2) & (F.col(x) < frame * 0.2) & F.col("_open")
    filled = F.coalesce(F.col(number), F.when(in_l | F.col("_dbl"), F.col("_from_l")), F.when(in_r, F.col("_from_r")), F.when(first, 1)).cast("bigint")
    d = d.columns(_n=filled)
    d = d._same(d.df.drop("_dbl", "_open", "_rn", "_l", "_r", "_from_l", "_from_r", "_seen_l", "_seen_r"))
    wd = runtime.small(widths.select(*width_keys, F.col("number").cast("bigint").alias("_wn"), F.col("width").cast("double").alias("_w")))
    for name, of in (("_own", F.col("_n")), ("_prev", F.col("_n") - 1)):
        d = d._same(d.df.withColumn("_wn", of).join(wd.withColumnRenamed("_w", name), [*width_keys, "_wn"], "left").drop("_wn"))
    side = lambda w: F.struct(F.col(x).cast("double").alias("x"), F.col("_n").alias("n"), F.col(w).alias("w"))
    d = d.with_columns(_a=lag(side("_own")), _b=lead(side("_prev")))
    a, b, at = F.col("_a"), F.col("_b"), F.col(x).cast("double")
    to_a, to_b = a["x"] + a["w"], b["x"] - b["w"]
    found = F.coalesce(F.col("_n"), F.when(F.abs(to_a - at) < 4, a["n"] + 1), F.when((F.abs(to_b - at) < 4) & (b["n"] > 1), b["n"] - 1))
    # Each gap once: at its left boundary, or before the first one.
    nxt = at + F.col("_own")
    row = lambda p, n, new: F.struct(p.alias("x"), n.cast("bigint").alias("number"), F.lit(new).alias("inferred"))
    ahead = F.when((nxt >= 0) & (nxt < frame) & (b.isNull() | (nxt <= b["x"] - 4)) & (nxt != at), row(F.rint(nxt), F.col("_n") + 1, True))
    back = F.when((to_b >= at + 4) & (to_b < frame) & (b["n"] > 1) & (to_b != b["x"]), row(F.rint(to_b), b["n"] - 1, True))
    before = at - F.col("_prev")
    head = F.when(a.isNull() & (before >= 0) & (F.col("_n") > 1) & (before != at), row(F.rint(before), F.col("_n") - 1, True))
    rows = F.array_compact(F.array(row(at, found, False), F.coalesce(ahead, back), head))
    return d.result.select(*keys, unfold(rows).alias("_s")).select(*keys, "_s.*")


class _Clusters(Fold):
    """Each width joins the first earlier width close to it."""

    def __init__(self, schema):
        self.schema = f"{schema}, cluster double"

    def start(self):
        return []

    def step(self, core, acc, row, emit):
        # Changed in place: the state never leaves the task.
        width = row[0]
        for w in core:
            if abs(w - width) <= max(3.0, width * 0.02):
                emit(*row[1:], w)
                return core
        emit(*row[1:], width)
        core.append(width)
        return core


def width_consensus(df: DataFrame, keys, number: str, width: str, order: list[str], least: int = 2) -> DataFrame:
    """Most observed width of each number; the earliest of equals, trusted when seen ``least`` times.

    A width joins the first earlier one close to it, which depends on all that came before:
    a number is read in order by one task, which keeps its distinct widths.
    """
    by = [*keys, number]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in order)
    c = Ordered(df.withColumn("_w", F.col(width).cast("double")), by, order, chunked=False).fold(_Clusters(schema), ["_w", *order])
    g = c.groupBy(*by, "cluster").agg(F.count(F.lit(1)).alias("count"), F.min(F.struct(*order)).alias("_first"))
    out = best(g, by, [-F.col("count"), "_first"])
    return out.select(*by, F.col("cluster").alias("width"), "count", (F.col("count") >= least).alias("trusted"))


class _Patch(Fold):
    def __init__(self, margin, schema):
        self.margin, self.schema = margin, schema

    def step(self, core, acc, row, emit):
        if core is None or row[0] + self.margin < core[0]:
            return row
        return core

    def finish(self, core, acc, emit):
        if core is not None:
            emit(*core)


def best_patch(df: DataFrame, keys, quality: str, order: list[str], source: list[str], margin: float = 8.0) -> DataFrame:
    """Source with the least background; a later one must be better by more than ``margin``."""
    schema = f"{quality} double, " + ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in source)
    return Ordered(df.withColumn(quality, F.col(quality).cast("double")), keys, order).fold(_Patch(margin, schema), [quality, *source])


def vote_transient(df: DataFrame, keys, cell: str, t: str, tie: list[str], visible: Column, ink: Column, *, per_second=5.0, least=3, share=0.3) -> DataFrame:
    """Cells whose ink is not supported often enough by clear observations; one vote per time bucket."""
    d = df.select(*keys, cell, t, *tie, F.rint(F.col(t) * per_second).cast("bigint").alias("_b"), visible.alias("_v"), (visible & ink).alias("_s"))
    d = best(d, [*keys, cell, "_b"], [t, *tie])
    g = d.groupBy(*keys, cell).agg(F.count_if("_v").alias("clear"), F.count_if("_s").alias("support"))
    return g.withColumn("drop", (F.col("clear") >= least) & (F.col("support") < F.col("clear") * share))


def backward_reset(df: DataFrame, keys, order, numbers: str) -> DataFrame:
    """Does a stream's numbering jump back past the previous frame's numbers?"""
    d = df.filter(F.size(numbers) > 0).withColumns({"_lo": F.array_min(numbers), "_hi": F.array_max(numbers)})
    o = Ordered(d, keys, order).with_columns(_p=lag("_lo"))
    return o.result.groupBy(*keys).agg(F.bool_or(F.coalesce(F.col("_hi") < F.col("_p") - 1, F.lit(False))).alias("backward"))


def gap_report(df: DataFrame, keys, number: str, start0: bool = True, least: int = 8) -> DataFrame:
    """Missing numbers of each key; a key with too few or too many gaps is declined with one null row."""
    d = df.select(*keys, F.col(number).cast("bigint").alias("number")).distinct()
    s = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("number").alias("_lo"), F.max("number").alias("_hi"))
    first = F.when(F.lit(start0) & (F.col("_lo") <= 8), F.lit(1).cast("bigint")).otherwise(F.col("_lo"))
    s = s.withColumn("_from", first)
    gone = F.col("_hi") - F.col("_from") + 1 - F.col("_n")
    declined = (F.col("_n") < least) | (gone > F.greatest(F.lit(3.0), F.col("_n") * 0.08))
    s = s.withColumn("declined", declined)
    ok = d.join(s.filter("not declined").select(*keys, "_from", "_hi"), keys)
    miss = missing_numbers(ok, keys, "number", F.col("_from"), F.col("_hi"))
    return miss.withColumn("declined", F.lit(False)).unionByName(
        s.filter("declined").select(*keys, F.lit(None).cast("bigint").alias("missing"), "declined"))


def group_consecutive(df: DataFrame, keys, number: str, width: str, size: int = 4) -> DataFrame:
    """Rows of at most ``size`` consecutive numbers with their cumulative bounds."""
    o = Ordered(df, keys, [number]).with_columns(_p=lag(number), _rn=row_number())
    o = o.columns(_start=F.when(F.col("_p").isNull() | (F.col(number) != F.col("_p") + 1), F.col("_rn"))).with_columns(_s=last_known("_start"))
    o = o.columns(_new=F.when((F.col("_rn") - F.col("_s")) % size == 0, 1).otherwise(0)).with_columns(row=running_sum("_new"))
    g = o.result.groupBy(*keys, "row").agg(F.array_sort(F.collect_list(F.struct(F.col(number).alias("n"), F.col(width).alias("w")))).alias("_m"))
    bounds = F.transform(F.sequence(F.lit(0), F.size("_m")), lambda i: F.aggregate(F.slice("_m", F.lit(1), i), F.lit(0.0), lambda t, s: t + s["w"]))
    return g.select(*keys, "row", F.transform("_m", lambda s: s["n"]).alias("numbers"), bounds.alias("bounds"))


def weak_items(df: DataFrame, keys, quality: str, level: float = 150, share: float = 0.12) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg((F.col(quality) > level).cast("int")).alias("share")).filter(F.col("share") > share)


def unresolved_tail(df: DataFrame, keys, t: str, quality: str, number: str, ended: Column, tie: list[str], window: float = 12.0) -> DataFrame:
    """Clearest late sample showing the number after the last one and an end mark, else a warning.

    The last number is the largest seen before the tail.
    """
    end = df.groupBy(*keys).agg(F.max(t).alias("_end"))
    d = df.join(end, keys)
    tail = F.col(t) >= F.col("_end") - window
    last = d.groupBy(*keys).agg(F.max(F.when(~tail, F.col(number))).alias("_last"))
    cand = d.filter(tail & ended).join(last, keys).filter(F.col(number) == F.col("_last") + 1)
    pick = best(cand.select(*keys, t, quality, *tie), keys, [quality, t, *tie]).select(*keys, F.col(t).alias("t"))
    out = end.select(*keys).join(pick, keys, "left")
    return out.withColumn("warning", F.when(F.col("t").isNull(), "check the ending"))


def numbered_gate(df: DataFrame, keys, n_numbers: str, first: str) -> DataFrame:
    """Is a stream numbered, judged from its probes?"""
    usable = F.col(n_numbers) >= 2
    g = df.groupBy(*keys).agg(F.count_if(usable).alias("_n"), F.min(F.when(usable, F.col(first))).alias("_lo"), F.max(F.when(usable, F.col(first))).alias("_hi"))
    return g.select(*keys, F.coalesce((F.col("_n") >= 2) & (F.col("_hi") > F.col("_lo")), F.lit(False)).alias("numbered"))
