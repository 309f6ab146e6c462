"""Packing ordered items into rows, rows into pages, and events into bars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from obsflow.functions.exprs import unfold
from obsflow.plans.ordered import (
    Deal, Fold, Ordered, dealt, dealt_together, lag, last_known, lead, next_known, row_number, running_max, running_sum, total,
)

# Note lengths in quarters, longest first, and their names.
NOTE_LENGTHS = [(16.0, "long"), (8.0, "breve"), (4.0, "whole"), (2.0, "half"), (1.0, "quarter"),
                (0.5, "eighth"), (0.25, "16th"), (0.125, "32nd"), (0.0625, "64th")]
DOTS = [(0, 1.0), (1, 1.5), (2, 1.75)]
DIVISIONS = 960


def _typed(df: DataFrame, cols) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in cols)


def reflow_rows(items: DataFrame, keys, order, target: int, *, included: Column | None = None, measured: Column | None = None,
                scale: Column | None = None, override: Column | None = None, deal: Deal | None = None) -> DataFrame:
    """Rows of ``target`` items in order.

    A row ends early at an unmeasured item (which stands alone), at a change of scale and
    before an item with its own target; excluded items are skipped.  ``deal`` where the
    items are already dealt by the keys.
    """
    src = items if included is None else items.filter(included)
    lone = ~F.coalesce(F.lit(True) if measured is None else measured, F.lit(False)) if target else F.lit(True)
    own = F.coalesce((F.lit(0) if override is None else override).cast("int"), F.lit(0))
    src, deal = dealt(src, keys, deal)
    o = Ordered(src.withColumns({"_lone": lone, "_s": F.lit(1.0) if scale is None else scale, "_o": own}), keys, order, chunked=deal.chunked)
    # A stretch starts where its first item asks for it; only its first row can have its own target.
    o = o.with_columns(_rn=row_number(), _p=lag(F.struct("_lone", "_s")))
    p = F.col("_p")
    o = o.columns(_start=F.when(F.col("_lone") | p.isNull() | p["_lone"] | ~p["_s"].eqNullSafe(F.col("_s")) | (F.col("_o") != 0),
                                F.struct(F.col("_rn").alias("rn"), F.when(F.col("_o") != 0, F.col("_o")).otherwise(target).alias("first"))))
    o = o.with_columns(_in=last_known("_start"))
    k, first = F.col("_rn") - F.col("_in")["rn"], F.col("_in")["first"]
    later = k - first
    pos = F.when(F.col("_lone"), 1).when(k < first, k + 1).otherwise(later % max(target, 1) + 1)
    size = F.when(F.col("_lone"), 0).when(k < first, first).otherwise(target)
    o = o.columns(pos=pos.cast("int"), row_target=size.cast("int")).with_columns(row=running_sum(F.when(F.col("pos") == 1, 1).otherwise(0).cast("bigint")))
    return o.result.select(*keys, *[c for c in items.columns if c not in keys], "row", "pos", "row_target")


def row_width_fraction(rows: DataFrame, keys, row: str, width: str, bars: str, row_target: str, target: int, deal: Deal | None = None) -> DataFrame:
    """Printed width of short rows relative to a complete row of the default target; ``deal`` where the rows are already dealt by the keys."""
    rows, deal = dealt(rows, keys, deal)
    # One pass: complete rows first, by width, so that their middle ranks give the median.
    done = (F.col(bars) == target) & (F.col(row_target) == target)
    o = Ordered(rows.withColumn("_done", F.when(done, 0).otherwise(1)), keys, ["_done", width, row], chunked=deal.chunked)
    o = o.with_columns(_rn=row_number(), _n=total(lambda c: F.count(c), F.when(F.col("_done") == 0, 1), merge=F.sum),
                       _most=total(F.max, F.when(F.col(bars) > 0, F.col(width))))
    mid = (F.col("_done") == 0) & ((F.col("_rn") == F.floor((F.col("_n") + 1) / 2)) | (F.col("_rn") == F.floor(F.col("_n") / 2) + 1))
    o = o.columns(_mid=F.when(mid, F.col(width))).with_columns(_sum=total(F.sum, "_mid"), _cnt=total(lambda c: F.count(c), "_mid", merge=F.sum))
    ref = F.coalesce(F.when(F.col("_cnt") > 0, F.col("_sum") / F.col("_cnt")), F.col("_most"), F.lit(1.0))
    short = (F.col(bars) > 0) & (F.col(bars) < F.col(row_target))
    out = o.columns(width_fraction=F.when(short, F.least(F.lit(1.0), F.col(width) / ref)).otherwise(1.0)).result
    return out.select(*rows.columns, "width_fraction")


def _flush(o: Ordered, limit: Column, end: Column, keep: list[str]) -> DataFrame:
    """Rows that end at a limit (0: none; the same for a whole key) or after a marked item."""
    o = o.columns(_limit=F.coalesce(limit.cast("bigint"), F.lit(0).cast("bigint")), _end=F.coalesce(end, F.lit(False))).with_columns(_rn=row_number())
    o = o.columns(_stop=F.when(F.col("_end"), F.col("_rn"))).with_columns(_from=last_known("_stop", inclusive=False))
    k = F.col("_rn") - F.coalesce("_from", F.lit(0)) - 1
    o = o.columns(pos=(F.when(F.col("_limit") > 0, k % F.col("_limit")).otherwise(k) + 1).cast("int"))
    o = o.with_columns(row=running_sum(F.when(F.col("pos") == 1, 1).otherwise(0).cast("bigint")))
    return o.result.select(*o.keys, *keep, "row", "pos")


def printed_slots(bars: DataFrame, groups: DataFrame, keys, number: str, system_end: str, breaks: DataFrame | None = None,
                  bars_per_line: int = 0, source_per_line: int = 4, print_rows: DataFrame | None = None, deal: Deal | None = None) -> DataFrame:
    """Printed rows of slots; a merged rest block is one slot.

    ``groups``: keys, first, last of merged blocks.  Rows follow the source's line ends
    unless ``bars_per_line`` overrides them; ``breaks`` (keys, number) always end a row.
    ``print_rows`` (keys, row, pos, number), when given, states the rows: slots that start
    at a listed number stand where they are listed, others are left out, and rows without
    any slot do not count.  ``deal`` where all frames are already dealt by the keys.
    """
    if deal is None:
        (bars, groups, breaks, print_rows), deal = dealt_together([bars, groups, breaks, print_rows], keys)
    few = bars.select(*keys, number, F.col(system_end).alias("_e"), F.lit(None).cast("bigint").alias("_g"))
    marks = groups.select(*keys, F.col("first").alias(number), F.lit(None).cast("boolean").alias("_e"), F.col("last").cast("bigint").alias("_g"))
    o = Ordered(few.unionByName(marks), keys, [number, "_g"], chunked=deal.chunked)
    block = F.when(F.col("_g").isNotNull(), F.struct(F.col(number).cast("bigint").alias("f"), F.col("_g").alias("l")))
    o = o.columns(_b=block).with_columns(_in=last_known("_b"), _next=lead("_b"))
    # Blocks are disjoint, so the latest block that started decides.
    at = F.when(F.col("_in")["l"] >= F.col(number), F.col("_in"))
    own = F.when(F.col("_next")["f"] == F.col(number), F.col("_next"))
    bars_only = o.columns(_hit=F.coalesce(at, own)).where(F.col("_b").isNull()).result
    if breaks is not None:
        bars_only = deal.join(bars_only, breaks.select(*keys, number, F.lit(True).alias("_br")), keys, [number], "left")
    else:
        bars_only = bars_only.withColumn("_br", F.lit(False))
    slot = F.coalesce(F.col("_hit")["f"], F.col(number).cast("bigint"))
    s = bars_only.groupBy(*keys, slot.alias("first")).agg(F.max(number).cast("bigint").alias("last"), F.bool_or("_e").alias("_e"), F.bool_or(F.coalesce("_br", F.lit(False))).alias("_br"))
    if print_rows is not None:
        listed = print_rows.select(*keys, F.col("row").alias("_row"), F.col("pos").alias("_pos"), F.col("number").cast("bigint").alias("first"))
        x = Ordered(deal.join(listed, s.select(*keys, "first", "last"), keys, ["first"]), keys, ["_row", "_pos"], chunked=deal.chunked).with_columns(_rn=row_number(), _p=lag("_row"))
        x = x.columns(_start=F.when(F.col("_p").isNull() | (F.col("_p") != F.col("_row")), F.col("_rn")))
        x = x.with_columns(_from=last_known("_start"), row=running_sum(F.when(F.col("_start").isNotNull(), 1).otherwise(0).cast("bigint")))
        return x.columns(pos=(F.col("_rn") - F.col("_from") + 1).cast("int")).result.select(*keys, "first", "last", "row", "pos")
    o = Ordered(s, keys, ["first"], chunked=o.fewer).with_columns(_any=total(F.bool_or, "_e"))
    fallback = max(1, min(16, source_per_line or 4))
    limit = F.lit(bars_per_line) if bars_per_line else F.when(F.col("_any"), 0).otherwise(fallback)
    end = F.col("_br") | (F.col("_e") if not bars_per_line else F.lit(False))
    return _flush(o, limit, F.coalesce(end, F.lit(False)), ["first", "last"])


def merged_label(first: Column, last: Column) -> Column:
    return F.when(first == last, first.cast("string")).otherwise(F.concat_ws("–", first.cast("string"), last.cast("string")))


class _Disjoint(Fold):
    schema = "first bigint, last bigint"

    def step(self, core, acc, row, emit):
        if core is None or row[0] > core:
            emit(*row)
            return row[1]
        return core


def merge_rest_runs(bars: DataFrame, explicit: DataFrame, keys, number: str, meter: str, rest: str, multirest: str | None = None,
                    deal: Deal | None = None) -> DataFrame:
    """Blocks of whole-bar rests printed as one: requested groups, then printed or automatic ones.

    ``explicit``: keys, grp, number.  A bad request comes back with an ``error`` and merges
    nothing.  Without ``multirest`` every run of at least two rests in one meter is merged;
    with it, only the blocks whose first bar states their length.  ``deal`` where bars and
    requests are already dealt by the keys.
    """
    if deal is None:
        (bars, explicit), deal = dealt_together([bars, explicit], keys)
    n = F.col(number).cast("bigint")
    want = explicit.select(*keys, "grp", n.alias("n"))
    have = bars.select(*keys, n.alias("n"), F.col(meter).alias("_m"), F.col(rest).alias("_r"))
    want = deal.of(want, [*keys, "n"])
    twice = want.groupBy(*keys, "n").agg(F.count(F.lit(1)).alias("_c"))
    w = deal.of(want.join(deal.of(have, [*keys, "n"]), [*keys, "n"], "left").join(twice, [*keys, "n"]), keys)
    g = w.groupBy(*keys, "grp").agg(F.min("n").alias("first"), F.max("n").alias("last"), F.count(F.lit(1)).alias("_n"), F.max("_c").alias("_c"),
                                    F.count("_r").alias("_found"), F.min("_m").alias("_ma"), F.max("_m").alias("_mz"), F.bool_and("_r").alias("_rest"))
    error = (F.when((F.col("_n") < 2) | (F.col("last") - F.col("first") + 1 != F.col("_n")), "not consecutive")
             .when((F.col("_c") > 1) | (F.col("_found") < F.col("_n")), "overlap or missing bars")
             .when((F.col("_ma") != F.col("_mz")) | ~F.col("_rest"), "not a verified rest"))
    g = g.withColumn("error", error)
    # Runs of rests of one meter.
    o = Ordered(have, keys, ["n"], chunked=deal.chunked).with_columns(_p=lag(F.struct("n", "_m", "_r")))
    p = F.col("_p")
    same = F.coalesce(F.col("_r") & p["_r"] & (p["n"] + 1 == F.col("n")) & (p["_m"] == F.col("_m")), F.lit(False))
    o = o.columns(_new=F.when(same, 0).otherwise(1)).with_columns(_run=running_sum("_new"))
    runs = o.result.filter("_r").groupBy(*keys, "_run").agg(F.min("n").alias("first"), F.max("n").alias("last"))
    if multirest is None:
        cand = runs.filter("last > first").select(*keys, "first", "last")
    else:
        block = bars.filter(F.col(multirest) >= 2).select(*keys, n.alias("first"), (n + F.col(multirest) - 1).cast("bigint").alias("last"))
        # The run that holds the block's first bar must reach its last bar.
        runs = runs.select(*keys, F.col("first").alias("_f"), F.col("last").alias("_l"))
        both = block.select(*keys, "first", "last", F.lit(1).alias("_k")).unionByName(runs.select(*keys, F.col("_f").alias("first"), F.col("_l").alias("last"), F.lit(0).alias("_k")))
        m = Ordered(both, keys, ["first", "_k", "last"], chunked=o.fewer).columns(_end=F.when(F.col("_k") == 0, F.col("last"))).with_columns(_reach=last_known("_end"))
        cand = m.result.filter((F.col("_k") == 1) & (F.col("_reach") >= F.col("last"))).select(*keys, "first", "last")
    # A candidate meeting a valid requested group is dropped: requested groups are disjoint intervals.
    good = g.filter("error is null").select(*keys, "first", "last")
    tagged = cand.withColumn("_k", F.lit(1)).unionByName(good.withColumn("_k", F.lit(0)))
    c = Ordered(tagged, keys, ["first", "_k", "last"], chunked=o.fewer).columns(_gl=F.when(F.col("_k") == 0, F.col("last")), _gf=F.when(F.col("_k") == 0, F.col("first")))
    c = c.with_columns(_before=running_max("_gl"), _after=next_known("_gf"))
    clear = (F.coalesce("_before", F.lit(-1)) < F.col("first")) & (F.col("_after").isNull() | (F.col("_after") > F.col("last")))
    taken = c.where((F.col("_k") == 1) & clear).select("first", "last")
    # Runs are disjoint; stated blocks may overlap, and then the earlier one holds.
    taken = taken.result.select(*keys, "first", "last") if multirest is None else taken.fold(_Disjoint(), ["first", "last"])
    out = g.select(*keys, "first", "last", "error", F.lit("requested").alias("kind"))
    return out.unionByName(taken.select(*keys, "first", "last", F.lit(None).cast("string").alias("error"), F.lit("found").alias("kind")))


def regroup_kept(lines: DataFrame, keys, order, system_end: str, limit: int, fallback: int = 4) -> DataFrame:
    """Rows over the kept sequence: at the limit, or at line ends, or in source-sized chunks."""
    keep = [c for c in lines.columns if c not in keys]
    o = Ordered(lines, keys, order).with_columns(_any=total(F.bool_or, system_end))
    if limit:
        return _flush(o, F.lit(limit), F.lit(False), keep)
    return _flush(o, F.when(F.col("_any"), 0).otherwise(fallback), F.col(system_end), keep)


class _Stack(Fold):
    """Heights put one below the other; where each starts."""

    counters = 1

    def __init__(self, top: float, below_title: float, floor: float, gap: float, schema: str):
        self.top, self.below_title, self.floor, self.gap = top, below_title, floor, gap
        self.schema = f"{schema}, page bigint, y double"

    def step(self, core, acc, row, emit):
        tall = row[0]
        if tall is None:
            emit(*row[1:], None, None)
            return core
        if core is None:
            acc[0] += 1
            at = self.below_title
        else:
            at = core
        if at - tall < self.floor:
            acc[0] += 1
            at = self.top
        emit(*row[1:], acc[0], at)
        return at - (tall + self.gap)


def page_pack(rows: DataFrame, keys, order, w: str, h: str, page: dict, scale: Column | None = None, fraction: Column | None = None) -> DataFrame:
    """Place rows down the page; a row that would cross the floor starts a new page.

    ``page``: width, height, top, floor, gap and the title's reserve on the first page.
    A row taller than the room is shrunk to it.  A row without a positive width or a
    height has null places and takes none.
    """
    top = page["height"] - page["top"]
    room = top - page["floor"] - page["reserve"]
    wide, tall = F.col(w).cast("double"), F.col(h).cast("double")
    full = page["width"] * (F.lit(1.0) if fraction is None else fraction)
    high = F.when(wide > 0, tall * full / wide * (F.lit(1.0) if scale is None else scale))
    shrink = F.when(high > room, room / high).otherwise(1.0)
    keep = [c for c in rows.columns if c not in keys and c not in (w, h)]
    src = rows.withColumns({"draw_h": high * shrink, "draw_w": F.when(high.isNotNull(), full * shrink)})
    fold = _Stack(top, top - page["reserve"], page["floor"], page["gap"], f"{_typed(rows, keep)}, draw_w double, draw_h double" if keep else "draw_w double, draw_h double")
    return Ordered(src, keys, order).fold(fold, ["draw_h", *keep, "draw_w", "draw_h"])


def fixed_rows_per_page(rows: DataFrame, keys, order, height: float) -> DataFrame:
    per = max(1, int((height - 170) / 56))
    o = Ordered(rows, keys, order).with_columns(_rn=row_number())
    return o.result.withColumns({"page": F.floor((F.col("_rn") - 1) / per), "pos": (F.col("_rn") - 1) % per}).drop("_rn")


def _piece_size(unit: float, budget: float, pad: float) -> int:
    """Characters of a piece of a token that is wider than a row."""
    return max(1, int((budget - pad) // unit))


class _Wrap(Fold):
    counters = 1

    def __init__(self, unit, pad, budget, order_type):
        self.unit, self.pad, self.budget = unit, pad, budget
        self.schema = f"at {order_type}, row bigint, pos int, piece string"

    def step(self, core, acc, row, emit):
        at, text = row
        width = len(text or "") * self.unit + self.pad
        if width > self.budget:
            size = _piece_size(self.unit, self.budget, self.pad)
            for i in range(0, len(text or ""), size):
                acc[0] += 1
                emit(at, acc[0], 1, text[i : i + size])
            return None
        if core is None or core[0] + width > self.budget:
            acc[0] += 1
            core = (0.0, 0)
        emit(at, acc[0], core[1] + 1, text)
        return (core[0] + width, core[1] + 1)


def greedy_wrap(tokens: DataFrame, keys, order: str, text: str, unit: float, budget: float, pad: float = 10.0) -> DataFrame:
    """Fill rows with tokens up to a width budget; a token wider than a row is split by character.

    A null token takes the room of an empty one.
    """
    return Ordered(tokens, keys, [order]).fold(_Wrap(unit, pad, budget, tokens.schema[order].dataType.simpleString()), [order, text])


# Tokens of several lines that are wrapped together; a longer line is wrapped alone.
_WRAP_TOKENS = 65_536


def _wrap_lines(sizes: list[int], lengths: list[int], unit: float, budget: float, pad: float) -> tuple[list[int], list[int], list[tuple[int, int]]]:
    """Row and place of every token of lines of ``sizes`` tokens, and (token, pieces) of those wider than a row."""
    size = _piece_size(unit, budget, pad)
    row_of, pos_of, wide = [], [], []
    widths = iter([n * unit + pad for n in lengths])
    for n in sizes:
        row, pos, used = 0, 0, None
        for _, width in zip(range(n), widths):
            if width > budget:
                pieces = -(-lengths[len(row_of)] // size)
                wide.append((len(row_of), pieces))
                row_of.append(row + 1)
                pos_of.append(1)
                row, used = row + pieces, None
                continue
            if used is None or used + width > budget:
                row, pos, used = row + 1, 0, 0.0
            pos, used = pos + 1, used + width
            row_of.append(row)
            pos_of.append(pos)
    return row_of, pos_of, wide


def greedy_wrap_lines(lines: DataFrame, keys, tokens: str, unit: float, budget: float, pad: float = 10.0) -> DataFrame:
    """``greedy_wrap`` of lines that hold their tokens in an array, in order; one row has the whole line.

    Lines are wrapped by the task that reads them, without a count, a shuffle or a sort, and
    only lengths of tokens become Python values.  ``at`` is the place in the array, from 0.
    """
    src = lines.select(*keys, tokens)
    schema = T.StructType([src.schema[k] for k in keys] + T.StructType.fromDDL("at int, row bigint, pos int, piece string").fields)
    arrow, nk, size = to_arrow_schema(schema), len(keys), _piece_size(unit, budget, pad)

    def wrapped(batch):
        """Pieces of the lines of a batch."""
        held = batch.column(nk)
        sizes, flat = pc.fill_null(pc.list_value_length(held), 0).to_numpy(zero_copy_only=False), held.flatten()
        lengths = pc.fill_null(pc.utf8_length(flat), 0).to_pylist()
        row_of, pos_of, wide = _wrap_lines(sizes.tolist(), lengths, unit, budget, pad)
        line = np.repeat(np.arange(len(sizes)), sizes)
        at = np.arange(len(line)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        row, pos, piece = np.array(row_of, "int64"), np.array(pos_of, "int32"), flat
        if wide:
            times = np.ones(len(line), "int64")
            times[[t for t, _ in wide]] = [n for _, n in wide]
            token = np.repeat(np.arange(len(line)), times)
            nth = np.arange(len(token)) - np.repeat(np.cumsum(times) - times, times)
            parts = [text[i : i + size] for text in flat.take(pa.array([t for t, _ in wide])).to_pylist() for i in range(0, len(text or ""), size)]
            cut = np.zeros(len(line), bool)
            cut[[t for t, _ in wide]] = True
            piece = pc.replace_with_mask(flat.take(pa.array(token)), pa.array(cut[token]), pa.array(parts, flat.type))
            line, at, row, pos = line[token], at[token], row[token] + nth, pos[token]
        cols = [c.take(pa.array(line)) for c in batch.columns[:nk]] + [pa.array(at), pa.array(row), pa.array(pos), piece]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, arrow)], schema=arrow)

    def run(batches):
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(nk)), 0).to_numpy(zero_copy_only=False))
            start = 0
            while start < batch.num_rows:
                done = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, done + _WRAP_TOKENS, "right")))
                yield wrapped(batch.slice(start, stop - start))
                start = stop

    return src.mapInArrow(run, schema)


def proportional_spacing(events: DataFrame, keys, order, width: str, duration: str, budget: float) -> DataFrame:
    """Positions that keep a minimum gap and share spare room by the root of the duration.

    ``x`` is null where the minimum gaps alone do not fit.
    """
    o = Ordered(events, keys, order).with_columns(_nw=lead(width))
    o = o.columns(_min=F.when(F.col("_nw").isNotNull(), (F.col(width) + F.col("_nw")) / 2 + 2.2),
                  _wt=F.when(F.col("_nw").isNotNull(), F.sqrt(duration)))
    o = o.with_columns(_min_sum=total(F.sum, "_min"), _wt_sum=total(F.sum, "_wt"), _min_run=running_sum("_min", inclusive=False),
                       _wt_run=running_sum("_wt", inclusive=False))
    spare = F.greatest(F.lit(0.0), F.lit(budget - 28.0) - F.coalesce("_min_sum", F.lit(0.0)))
    x = F.lit(14.0) + F.col("_min_run") + F.coalesce(spare * F.col("_wt_run") / F.col("_wt_sum"), F.lit(0.0))
    fits = F.coalesce(F.col("_min_sum"), F.lit(0.0)) <= budget - 25
    return o.columns(x=F.when(fits, x)).result.drop("_nw", "_min", "_wt", "_min_sum", "_wt_sum", "_min_run", "_wt_run")


def rhythm_class(duration: Column) -> Column:
    """Struct (type, dots, triplet) of a note length, null for an unsupported one."""
    plain = [(base * f, name, d, False, 0.0001) for d, f in DOTS for base, name in NOTE_LENGTHS]
    triplet = [(base * 2 / 3, name, 0, True, 0.001) for base, name in NOTE_LENGTHS]
    out = F
    for v, n, d, t, e in plain + triplet:
        out = out.when(F.abs(duration - v) < e, F.struct(F.lit(n).alias("type"), F.lit(d).alias("dots"), F.lit(t).alias("triplet")))
    return out


def beam_groups(events: DataFrame, keys, order, onset: str, duration: str, has_notes: Column, beat: Column) -> DataFrame:
    """Beam of every event at each level: begin, continue, end, or a hook."""
    ok = has_notes & (F.col(duration) > 0) & (F.col(duration) < 1)
    level = rhythm_class(F.col(duration))["type"]
    depth = F.coalesce(F.when(level == "eighth", 1).when(level == "16th", 2).when(level == "32nd", 3).when(level == "64th", 4), F.lit(0))
    cell = F.when(ok, F.floor((F.col(onset) + 0.001) / beat))
    o = Ordered(events, keys, order).columns(_c=cell, _d=depth)
    o = o.with_columns(_p=lag(F.struct("_c", "_d")), _n=lead(F.struct("_c", "_d")))
    before, after = F.col("_p")["_c"] == F.col("_c"), F.col("_n")["_c"] == F.col("_c")
    o = o.columns(_b=F.when(before, F.col("_p")["_d"]), _a=F.when(after, F.col("_n")["_d"]))
    out = o.where(F.col("_c").isNotNull() & (F.col("_b").isNotNull() | F.col("_a").isNotNull()) & (F.col("_d") > 0)).result
    out = out.withColumn("level", F.explode(F.sequence(F.lit(1), F.col("_d"))))
    b, a = F.coalesce(F.col("_b") >= F.col("level"), F.lit(False)), F.coalesce(F.col("_a") >= F.col("level"), F.lit(False))
    kind = F.when(b & a, "continue").when(b, "end").when(a, "begin").when(F.col("_b").isNotNull(), "backward hook").otherwise("forward hook")
    return out.withColumn("kind", kind).drop("_c", "_d", "_p", "_n", "_b", "_a")


def score_timeline(events: DataFrame, keys, pos: str, onset: str, duration: str, staff: str, voice: str, has_notes: Column, grace: Column | None = None) -> DataFrame:
    """Written order of a bar: forward gaps, notes and rests per voice, and backups between voices.

    The cursor is the furthest end so far, so a short event after a long one makes no gap.
    Grace events come before others at their onset and take no time.
    """
    by = [*keys, staff, voice]
    if grace is not None:
        events = events.withColumns({"_late": ~F.coalesce(grace, F.lit(False)), duration: F.when(grace, 0.0).otherwise(F.col(duration))})
    o = Ordered(events, by, [onset, *([] if grace is None else ["_late"]), pos]).columns(_end=F.col(onset) + F.col(duration))
    o = o.with_columns(_cursor=running_max("_end", inclusive=False), _furthest=running_max("_end"), _last=lead(pos))
    cursor = F.coalesce("_cursor", F.lit(0.0))
    units = lambda c: F.rint(c * DIVISIONS).cast("bigint")
    gap = F.when(F.col(onset) > cursor + 0.001, F.struct(F.lit("forward").alias("kind"), units(F.col(onset) - cursor).alias("divisions")))
    body = F.struct(F.when(has_notes, "note").otherwise("rest").alias("kind"), units(F.col(duration)).alias("divisions"))
    parts = o.result.select(*by, F.col(pos).cast("bigint").alias("pos"), unfold(F.array_compact(F.array(gap, body))).alias("_e")).select(*by, "pos", "_e.*")
    ends = o.result.filter("_last is null").select(*by, F.col("_furthest").alias("_end"))
    v = Ordered(ends, keys, [staff, voice], chunked=False if keys and not o.chunked else None).with_columns(_len=lag("_end"))
    back = v.result.filter("_len > 0").select(*by, F.lit(0).cast("bigint").alias("pos"), F.lit("backup").alias("kind"), units(F.col("_len")).alias("divisions"))
    return parts.unionByName(back)


def timeline_directions(bars: DataFrame, events: DataFrame, keys, bar: list[str], order: list[str], tempo: str, onset: str, pos: list[str], words: str, grace: Column | None = None) -> DataFrame:
    """What is written above the music: a tempo where it changes, words once for each onset of a bar.

    ``bars``: keys, bar, order, tempo (null or 0: none stated).  ``events``: keys, bar, onset,
    pos, words.  The first event by ``pos`` that has the words carries them; words of grace
    events are not written.
    """
    value = F.when(F.col(tempo) >= 1, F.floor(F.col(tempo)))
    t = Ordered(bars.withColumn("_t", value), keys, order).with_columns(_was=last_known("_t", inclusive=False)).result
    t = t.filter(F.col("_t").isNotNull() & ~F.col("_t").eqNullSafe(F.col("_was")))
    none = F.lit(None)
    t = t.select(*keys, *bar, F.lit("tempo").alias("kind"), none.cast("double").alias("onset"), F.col("_t").cast("string").alias("text"))
    e = events.filter((F.col(words) != "") & (F.lit(True) if grace is None else ~F.coalesce(grace, F.lit(False))))
    w = e.groupBy(*keys, *bar, F.col(onset).cast("double").alias("onset"), F.col(words).alias("text")).agg(F.min(F.struct(*pos)).alias("_first"))
    return t.unionByName(w.select(*keys, *bar, F.lit("words").alias("kind"), "onset", "text"))
