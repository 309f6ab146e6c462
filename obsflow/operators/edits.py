"""Replaying logs of edits over ordered lines.

A project's edits refer to positions that earlier edits moved, so its log is replayed in
order by one task.  The task holds runs of original positions, not lines: memory and time
grow with the project's edits, by a logarithm each.  The lines, however many, are numbered
and joined to the final runs in Spark.
"""

from __future__ import annotations

from array import array
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsflow.functions.exprs import finite
from obsflow.operators.pieces import MovedRuns, PieceTable
from obsflow.plans.ordered import Fold, Ordered, row_number, running_sum
from obsflow.plans.ranges import explode_range

# Marks of a line: as it was, then what its last include said.
_MARKS = {False: 1, True: 2, None: 3}
_RUNS = "kind string, seq bigint, at array<bigint>, first array<bigint>, size array<bigint>, mark array<tinyint>"


class _Replay(Fold):
    schema = _RUNS

    def start(self):
        return PieceTable(0), (array("q"), array("q"), array("b"))

    def step(self, core, acc, row, emit):
        n, seq, included, op, index, direction = row
        if n is not None:
            return PieceTable(n), core[1]
        # Changed in place: the state never leaves the task.
        items, (places, lines, marks) = core
        if op == "undo":
            if not places:
                emit("rejected", seq, None, None, None, None)
            else:
                items.insert(min(places.pop(), items.n), (lines.pop(), marks.pop()))
        elif index is None or not 0 <= index < items.n:
            emit("rejected", seq, None, None, None, None)
        elif op == "remove":
            line, mark = items.remove(index)
            places.append(index)
            lines.append(line)
            marks.append(mark)
        elif op == "duplicate":
            items.insert(index + 1, items.get(index))
        elif op == "move":
            to = index + (direction or 0)
            if to != index and 0 <= to < items.n:
                low, high = min(index, to), max(index, to)
                b, a = items.remove(high), items.remove(low)
                items.insert(low, b)
                items.insert(high, a)
        elif op == "include":
            items.insert(index, (items.remove(index)[0], _MARKS[included]))
        return core

    def finish(self, core, acc, emit):
        for at, first, size, mark in core[0].runs():
            emit("line", None, list(accumulate(size[:-1], initial=at)), first, size, mark)


def _numbered(lines: DataFrame, keys, order, line: str) -> DataFrame:
    """Lines with their rank from 0, under names of their own."""
    o = Ordered(lines.select(*keys, *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.col(line).cast("bigint").alias("_line")), keys, [f"_o{i}" for i in range(len(order))])
    d = o.with_columns(_rank=row_number()).result
    return d.select(*[F.col(k).alias(f"_k_{k}") for k in keys], (F.col("_rank") - 1).alias("_rank"), "_line")


def _spread(runs: DataFrame, keys, *more: str) -> DataFrame:
    """A row for each place of the final list: its number and the rank of its line."""
    r = runs.select(*keys, "kind", *more, F.explode(F.arrays_zip("at", "first", "size", "mark")).alias("r")).select(*keys, "kind", *more, "r.*")
    r = explode_range(r, "_of", F.col("first"), F.col("first") + F.col("size") - 1)
    return r.withColumn("seq", F.col("at") + F.col("_of") - F.col("first"))


def _same(a: DataFrame, b: DataFrame, keys) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & a[k].eqNullSafe(b[f"_k_{k}"])
    return cond


def replay_edits(lines: DataFrame, log: DataFrame, keys, line_order, line: str, log_order) -> DataFrame:
    """Final order of each project's lines, and the edits that were out of range.

    ``log``: keys, op, index, direction, included.  A log without lines has all its edits
    rejected but those that undo nothing else.
    """
    numbered = _numbered(lines, keys, line_order, line)
    a = lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    a = a.select(*keys, F.lit(0).alias("_side"), F.lit(None).cast(_type(log, log_order)).alias("_go"), "_n", F.lit(None).cast("bigint").alias("seq"),
                 F.lit(None).cast("boolean").alias("included"), F.lit(None).cast("string").alias("op"), F.lit(None).cast("bigint").alias("index"), F.lit(None).cast("bigint").alias("direction"))
    b = log.select(*keys, F.lit(1).alias("_side"), F.struct(*log_order).alias("_go"), F.lit(None).cast("bigint").alias("_n"), F.col(log_order[-1]).cast("bigint").alias("seq"),
                   F.col("included"), F.col("op"), F.col("index").cast("bigint").alias("index"), F.col("direction").cast("bigint").alias("direction"))
    runs = Ordered(a.unionByName(b), keys, ["_side", "_go"], chunked=False).fold(_Replay(), ["_n", "seq", "included", "op", "index", "direction"])
    # A rejected edit is a run of one place that no line has.
    one = lambda v, t: F.array(F.lit(v).cast(t))
    runs = runs.withColumns({"_seq": F.col("seq"), "at": F.coalesce("at", one(0, "bigint")), "first": F.coalesce("first", one(-1, "bigint")), "size": F.coalesce("size", one(1, "bigint")),
                             "mark": F.coalesce("mark", one(0, "tinyint"))})
    places = _spread(runs, keys, "_seq")
    out = places.join(numbered, _same(places, numbered, keys) & (places["_of"] == numbered["_rank"]), "left")
    mark = F.col("mark")
    return out.select(*[places[k] for k in keys], "kind", F.when(F.col("kind") == "line", F.col("seq")).otherwise(F.col("_seq")).alias("seq"), F.col("_line").alias("line"),
                      F.when(F.col("kind") == "line", F.when(mark == 0, True).when(mark == 1, False).when(mark == 2, True)).alias("included"))


def _type(df: DataFrame, cols):
    return df.select(F.struct(*cols).alias("s")).schema["s"].dataType


def edit_state(lines: DataFrame, log: DataFrame, keys, line: str, seq: str, width: Column, height: Column) -> DataFrame:
    """Crop and height of each line after its edits: the last valid write wins.

    ``lines``: keys, line, crop.  ``log``: keys, line, seq, crop, reset, height_scale,
    all_heights.  An edit with a crop below 2x2 pixels or a height outside 0.25..2 is
    ignored as a whole.
    """
    c = F.col("crop")
    sized = ((F.floor(c[2] * width) - F.floor(c[0] * width)) >= 2) & ((F.floor(c[3] * height) - F.floor(c[1] * height)) >= 2)
    inside = (c[0] >= 0) & (c[0] < c[2]) & (c[2] <= 1) & (c[1] >= 0) & (c[1] < c[3]) & (c[3] <= 1)
    crop_ok = c.isNull() | F.coalesce(sized & inside, F.lit(False))
    scale_ok = F.col("height_scale").isNull() | (finite(F.col("height_scale")) & F.col("height_scale").between(0.25, 2))
    good = log.filter(F.coalesce(F.col("reset"), F.lit(False)) | (crop_ok & scale_ok))
    reset = F.coalesce(F.col("reset"), F.lit(False))
    every = F.coalesce(F.col("all_heights"), F.lit(False)) & ~reset
    mine = good.groupBy(*keys, line).agg(
        F.max_by(F.when(reset, F.lit(None)).otherwise(c), F.when(reset | c.isNotNull(), F.col(seq))).alias("_crop"),
        F.max(F.when(reset, F.col(seq))).alias("_reset"),
        F.max(F.when(~every & (reset | F.col("height_scale").isNotNull()), F.struct(F.col(seq).alias("s"), F.when(reset, 1.0).otherwise(F.col("height_scale")).alias("h")))).alias("_own"))
    shared = good.filter(every & F.col("height_scale").isNotNull()).groupBy(*keys).agg(
        F.max(F.struct(F.col(seq).alias("s"), F.col("height_scale").alias("h"))).alias("_all"))
    out = lines.join(mine, [*keys, line], "left").join(shared, keys, "left")
    last = F.greatest("_own", "_all")
    return out.select(*keys, line, F.coalesce("_crop", "crop").alias("crop"), F.coalesce(last["h"], F.lit(1.0)).alias("height_scale"))


def hide_excluded(lines: DataFrame, keys, order, included: str) -> DataFrame:
    """Excluded lines as removed entries that remember their place among the visible ones."""
    o = Ordered(lines, keys, order).with_columns(index=running_sum(F.col(included).cast("bigint"), inclusive=False))
    return o.columns(visible=F.col(included)).result


class _Moves(Fold):
    schema = "kind string, at array<bigint>, first array<bigint>, size array<bigint>, mark array<tinyint>"

    def step(self, core, acc, row, emit):
        n, rank, before, end, same = row
        if n is not None:
            return [MovedRuns(n), False]
        if core is None or core[1]:
            return core
        if rank is None or same or (before is None and not end):
            core[1] = True
        else:
            core[0].move(rank, None if end else before)
        return core

    def finish(self, core, acc, emit):
        if core is None:
            return
        at = 0
        runs = [(0, core[0].n)] if core[1] else list(core[0].runs())
        for k in range(0, len(runs), 512):
            first, size = zip(*runs[k:k + 512], strict=True)
            emit("rejected" if core[1] else "line", list(accumulate(size[:-1], initial=at)), list(first), list(size), [0] * len(first))
            at += sum(size)


def move_before(lines: DataFrame, moves: DataFrame, keys, line: str, target: str, before: str, order: str) -> DataFrame:
    """Apply a batch of moves by original line number (0 = to the end); an unknown line rejects the batch.

    Line numbers are unique within a project.
    """
    numbered = _numbered(lines, keys, [line], line)
    a = lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    a = a.select(*keys, F.lit(0).alias("_side"), F.lit(None).cast("bigint").alias("_at"), "_n", *[F.lit(None).cast(t).alias(c) for c, t in (("_rank", "bigint"), ("_before", "bigint"), ("_end", "boolean"), ("_same", "boolean"))])
    m = moves.select(*keys, F.col(order).cast("bigint").alias("_at"), F.col(target).cast("bigint").alias("_t"), F.col(before).cast("bigint").alias("_b"))
    for name, column in (("_rank", "_t"), ("_before", "_b")):
        right = numbered.select(*[F.col(f"_k_{k}").alias(f"_k_{k}") for k in keys], F.col("_line").alias("_l"), F.col("_rank").alias("_r"))
        m = m.join(right, _same(m, right, keys) & (m[column] == right["_l"]), "left").select(*[m[k] for k in keys], *[c for c in m.columns if c not in keys], F.col("_r").alias(name))
    end = F.coalesce(F.col("_b"), F.lit(0)) == 0
    b = m.select(*keys, F.lit(1).alias("_side"), "_at", F.lit(None).cast("bigint").alias("_n"), "_rank", "_before", end.alias("_end"), (~end & (F.col("_b") == F.col("_t"))).alias("_same"))
    runs = Ordered(a.unionByName(b), keys, ["_side", "_at"], chunked=False).fold(_Moves(), ["_n", "_rank", "_before", "_end", "_same"])
    places = _spread(runs, keys)
    out = places.join(numbered, _same(places, numbered, keys) & (places["_of"] == numbered["_rank"]))
    return out.select(*[places[k] for k in keys], "seq", F.col("_line").alias("line"), (F.col("kind") == "rejected").alias("rejected"))
