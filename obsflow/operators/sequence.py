"""Segmentation, duplicate removal and overlap of consecutive observations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsflow.plans.ordered import Fold, Ordered, count_all, lag, row_number


def absolute_difference(a, b) -> float:
    return abs(a - b)


class _Views(Fold):
    """A view stays open while samples agree with the sample that opened it."""

    counters = 1

    def __init__(self, threshold, interval, end, diff, content, sig_type):
        self.threshold, self.interval, self.end = threshold, interval, end
        self.diff, self.content = diff, content
        self.schema = f"view bigint, t0 double, until double, count bigint, anchor {sig_type}"

    def _close(self, core, acc, emit):
        if core is not None:
            anchor, t0, last, n = core
            until = last + self.interval
            acc[0] += 1
            emit(acc[0], t0, until if self.end is None else min(self.end, until), n, anchor)

    def step(self, core, acc, row, emit):
        t, sig = row
        if core is not None and sig is not None and self.diff(core[0], sig) <= self.threshold:
            return (core[0], core[1], t, core[3] + 1)
        self._close(core, acc, emit)
        return (sig, t, t, 1) if sig is not None and self.content(sig) else None

    def finish(self, core, acc, emit):
        self._close(core, acc, emit)


def _always(_):
    return True


def stable_views(df: DataFrame, keys, order, t, sig, threshold, interval, *, end=None,
                 diff: Callable = absolute_difference, content: Callable = _always) -> DataFrame:
    """Views of samples within ``threshold`` of the first sample of the view.

    ``diff(anchor, sample)`` is a plain function of two signatures; a null signature,
    or one without content, closes the view without opening another.
    """
    kind = df.schema[sig].dataType.simpleString()
    return Ordered(df, keys, order).fold(_Views(threshold, interval, end, diff, content, kind), [t, sig])


def min_support(views: DataFrame, keys, k: int = 2) -> tuple[DataFrame, DataFrame]:
    """Views seen at least ``k`` times, and per key how many were kept and rejected."""
    kept = views.filter(F.col("count") >= k)
    report = views.groupBy(*keys).agg(
        F.count_if(F.col("count") >= k).alias("kept"), F.count_if(F.col("count") < k).alias("rejected")
    )
    return kept, report


def view_sample(samples: DataFrame, keys, view, tie, n: int = 9) -> DataFrame:
    """At most ``n`` samples of every view, chosen uniformly by a hash of the sample."""
    by = [*keys, *view]
    h = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in [*by, *tie]]))
    w = Window.partitionBy(*by).orderBy(h, *tie)
    return samples.withColumn("pick", F.row_number().over(w)).filter(F.col("pick") <= n)


def median_composite(samples: DataFrame, keys, raster: str) -> DataFrame:
    """Element-wise exact median of integer rasters per view, truncated."""
    cells = samples.select(*keys, F.posexplode(raster).alias("pos", "v"))
    med = cells.groupBy(*keys, "pos").agg(F.median("v").cast("int").alias("m"))
    # One raster per view comes together here; the samples do not.
    out = med.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("r"))
    return out.select(*keys, F.transform("r", lambda x: x["m"]).alias(raster))


def blank_reject(views: DataFrame, raster: str, level=110, share=0.003) -> DataFrame:
    dark = F.size(F.filter(raster, lambda x: x < level)) / F.size(raster)
    return views.withColumn("ink_share", dark).withColumn("rejected", F.col("ink_share") < share)


def equal_rows(a: Column, b: Column) -> Column:
    return a == b


def _longest(prev: Column, cur: Column, same) -> Column:
    """Largest k whose last k rows of ``prev`` match the first k rows of ``cur``.

    Only lengths whose two ends match are compared in full, from the longest on, and none
    behind the first that matches.
    """
    most = F.least(F.size(prev), F.size(cur))

    def match(k):
        pairs = F.zip_with(F.slice(prev, F.size(prev) - k + 1, k), F.slice(cur, F.lit(1), k), same)
        return F.forall(pairs, lambda x: x)

    def ends(k):
        return F.coalesce(same(F.element_at(prev, -1), F.get(cur, k - 1)) & same(F.get(prev, F.size(prev) - k), F.get(cur, F.lit(0))), F.lit(False))

    ks = F.when(most > 0, F.filter(F.sequence(most, F.lit(1)), ends)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(F.coalesce(ks, F.array().cast("array<int>")), F.lit(0), lambda best, k: F.when(best > 0, best).when(match(k), k).otherwise(0))


class _Trim(Fold):
    """Overlap with the last accepted view; a dropped single row leaves it in place."""

    def __init__(self, same, multi_only, cols, schema):
        self.same, self.multi_only, self.n = same, multi_only, len(cols)
        self.schema = schema

    def start(self):
        return []

    def step(self, core, acc, row, emit):
        rows = row[-1] or []
        best = 0
        if self.multi_only and len(rows) == 1:
            best = 1 if core and self.same(core[-1], rows[0]) else 0
        elif not self.multi_only or (len(rows) > 1 and len(core) > 1):
            for k in range(min(len(core), len(rows)), 0, -1):
                if all(self.same(a, b) for a, b in zip(core[-k:], rows[:k])):
                    best = k
                    break
        emit(*row[:-1], rows[best:], best)
        return core if best == 1 and len(rows) == 1 else rows


def _equal(a, b):
    return a == b


def overlap_trim(views: DataFrame, keys, order, rows: str, *, same: Callable = equal_rows,
                 multi_only=False, hold_anchor=False, blank: Column | None = None,
                 same_value: Callable = _equal) -> DataFrame:
    """Drop the rows a view repeats from the view just before it, never from earlier ones.

    ``blank`` marks separators: nothing is trimmed across one.  With ``hold_anchor``
    a dropped single-row repeat does not become the comparison for the next view;
    ``same_value`` is then the row test as a plain function.
    """
    src = views if blank is None else views.withColumn(
        rows, F.when(blank, F.array().cast(views.schema[rows].dataType)).otherwise(F.col(rows)))
    o = Ordered(src, keys, order)
    if hold_anchor:
        keep = [c for c in src.columns if c not in keys and c != rows]
        fields = ", ".join(f"{c} {src.schema[c].dataType.simpleString()}" for c in keep)
        kind = src.schema[rows].dataType.simpleString()
        return o.fold(_Trim(same_value, multi_only, keep, f"{fields}, {rows} {kind}, overlap int"), [*keep, rows])
    o = o.with_columns(_prev=lag(rows))
    prev, cur = F.coalesce(F.col("_prev"), F.array().cast(src.schema[rows].dataType)), F.col(rows)
    if multi_only:
        one = F.when(F.size(prev) > 0, F.when(same(F.element_at(prev, -1), cur[0]), 1).otherwise(0)).otherwise(0)
        k = F.when((F.size(cur) > 1) & (F.size(prev) > 1), _longest(prev, cur, same)).when(F.size(cur) == 1, one).otherwise(0)
    else:
        k = _longest(prev, cur, same)
    out = o.result.withColumn("overlap", k)
    return out.withColumn(rows, F.slice(cur, F.col("overlap") + 1, F.greatest(F.size(cur), F.lit(1)))).drop("_prev")


class _Extend(Fold):
    def __init__(self, interval, seq_type):
        self.interval = interval
        self.schema = f"seq {seq_type}, visible_until double"

    def step(self, core, acc, row, emit):
        seq, t, until, repeat = row
        if repeat and core is not None:
            if core[1] is not None and abs(core[1] - t) <= 1.1 * self.interval:
                return (core[0], until)
            return core
        self.finish(core, acc, emit)
        return (seq, until)

    def finish(self, core, acc, emit):
        if core is not None:
            emit(*core)


def extend_visibility(lines: DataFrame, keys, order, seq, t, until, repeat, interval) -> DataFrame:
    """A line stays visible through directly following repeats that were dropped."""
    kind = lines.schema[seq].dataType.simpleString()
    return Ordered(lines, keys, order).fold(_Extend(interval, kind), [seq, t, until, repeat])


class _Hold(Fold):
    def __init__(self, heartbeat, cols, schema):
        self.heartbeat, self.schema = heartbeat, schema

    def step(self, core, acc, row, emit):
        t, fp, enabled = row[0], row[1], row[2]
        prev, last, pending, _ = core or (None, None, None, None)
        if enabled and fp is not None and fp == prev and last is not None and t - last < self.heartbeat:
            return (fp, last, row[3:], pending)
        if pending is not None:
            emit(*pending)
        emit(*row[3:])
        return (fp if enabled else None, t, None, None)

    def finish(self, core, acc, emit):
        # The stream's last row is always kept, after the row held before it.
        if core is not None and core[2] is not None:
            if core[3] is not None:
                emit(*core[3])
            emit(*core[2])


def hold_dedup(df: DataFrame, keys, order, t, fingerprint, heartbeat=6.0, enabled: Column | None = None) -> DataFrame:
    """Collapse consecutive equal fingerprints, keeping both ends of each hold,
    a row every ``heartbeat`` seconds and the last row of the stream."""
    keep = [c for c in df.columns if c not in keys]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    src = df.withColumn("_on", F.lit(True) if enabled is None else F.coalesce(enabled, F.lit(False)))
    return Ordered(src, keys, order).fold(_Hold(heartbeat, keep, schema), [t, fingerprint, "_on", *keep])


def join_overlapping_panels(panels: DataFrame, keys, order, cells: str, bounds: str, *,
                            tol=0.035, edge=1, snap=0, low=0.07, high=0.96) -> DataFrame:
    """Shift at which a panel continues the previous one, and the cut at their last common boundary.

    ``cells`` is the panel as an array; ``bounds`` the boundary positions in it.  A shift
    is accepted when the shared interior (edges trimmed) differs by at most ``tol``; the
    closest match wins, the smaller shift first.  Without a match or a common boundary
    both panels stay whole.
    """
    o = Ordered(panels, keys, order).with_columns(_pc=lag(cells), _pb=lag(bounds))
    a, b = F.col("_pc"), F.col(cells)
    w = F.size(a)
    trim = F.greatest(F.lit(edge), F.floor(w * 0.02)).cast("int")

    def shared(dx):
        length = w - dx - trim * 2
        pairs = F.zip_with(F.slice(a, dx + trim + 1, length), F.slice(b, trim + 1, length),
                           lambda x, y: F.when(x.eqNullSafe(y), 0).otherwise(1))
        return F.aggregate(pairs, F.lit(0), lambda s, v: s + v) / length

    tries = F.filter(F.sequence(F.lit(1), F.greatest(w - 1, F.lit(1))),
                     lambda d: (d > w * low) & (d < w * high) & (w - d - trim * 2 > 0))
    scored = F.transform(tries, lambda d: F.struct(shared(d).alias("e"), d.alias("d")))
    good = F.array_min(F.filter(scored, lambda s: s["e"] <= tol))
    usable = a.isNotNull() & (F.size(b) == w)
    out = o.result.withColumn("shift", F.when(usable, good["d"]))
    common = F.filter("_pb", lambda x: F.exists(bounds, lambda y: F.abs(y + F.col("shift") - x) <= snap))
    out = out.withColumn("cut_left", F.when(F.col("shift").isNotNull(), F.array_max(common)))
    near = F.filter(bounds, lambda y: F.abs(y + F.col("shift") - F.col("cut_left")) <= snap)
    out = out.withColumn("cut_right", F.when(F.col("cut_left").isNotNull(), F.array_max(near)))
    return out.withColumn("joined", F.col("cut_left").isNotNull()).drop("_pc", "_pb")


class _Snap(Fold):
    def __init__(self, tol, cols, schema):
        self.tol, self.n = tol, cols
        self.schema = schema

    def step(self, core, acc, row, emit):
        box = row[-1]
        if core is None or len(core) != len(box) or any(abs(a - b) > self.tol for a, b in zip(core, box)):
            core = list(box)
        emit(*row[:-1], core)
        return core


def snap_region(df: DataFrame, keys, order, box: str, tol=3) -> DataFrame:
    """Boxes within ``tol`` of the box in force keep that box."""
    keep = [c for c in df.columns if c not in keys and c != box]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in [*keep, box])
    return Ordered(df, keys, order).fold(_Snap(tol, len(keep), schema), [*keep, box])


def wander_test(df: DataFrame, keys, pos, height: Column, least=3) -> DataFrame:
    """Does a tracked position move by more than jitter?"""
    out = df.groupBy(*keys).agg(F.count(pos).alias("n"), (F.max(pos) - F.min(pos)).alias("spread"), F.max(height).alias("_h"))
    moves = (F.col("n") >= least) & (F.col("spread") > F.greatest(F.lit(8.0), F.lit(0.015) * F.col("_h")))
    return out.withColumn("moves", F.coalesce(moves, F.lit(False))).drop("_h")


class _Decimate(Fold):
    def __init__(self, tol, every, cols, schema):
        self.tol, self.every, self.schema = tol, every, schema

    def step(self, core, acc, row, emit):
        t, pos = row[0], row[1] or []
        prev, last = core or (None, None)
        still = prev is not None and len(prev) == len(pos) and all(abs(a - b) <= self.tol for a, b in zip(prev, pos))
        if not still or last is None or t - last >= self.every:
            emit(*row[2:])
            last = t
        return (list(pos), last)


def change_decimate(df: DataFrame, keys, order, t, positions, tol=2, every=0.35) -> DataFrame:
    """Keep samples whose positions changed, and otherwise one per ``every`` seconds."""
    keep = [c for c in df.columns if c not in keys]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return Ordered(df, keys, order).fold(_Decimate(tol, every, keep, schema), [t, positions, *keep])


def count_windows(df: DataFrame, keys, order, size=8, overlap=1) -> DataFrame:
    """Overlapping batches of ``size`` items; the last one reaches the end of the items."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below size")
    stride = size - overlap
    o = Ordered(df, keys, order).with_columns(_rn=row_number(), _n=count_all())
    i = F.col("_rn") - 1
    last = F.greatest(F.lit(0), F.ceil((F.col("_n") - overlap) / stride) - 1)
    first = F.greatest(F.lit(0), F.floor((i - size) / stride) + 1)
    out = o.result.withColumn("batch", F.explode(F.sequence(first.cast("bigint"), F.least(last, F.floor(i / stride)).cast("bigint"))))
    return out.withColumn("pos", i - F.col("batch") * stride).drop("_rn", "_n")


def ordered_distinct(df: DataFrame, keys, order, value) -> DataFrame:
    """Distinct values of each key in order of first appearance."""
    firsts = df.groupBy(*keys, value).agg(F.min(F.struct(*order)).alias("_f"))
    firsts = firsts.select(*keys, value, *[F.col("_f")[c].alias(c) for c in order])
    return Ordered(firsts, keys, order).with_columns(pos=row_number()).result.select(*keys, "pos", value)
