"""Per-key ordered computation that stays parallel when one key is very large.

``Ordered(df, keys, order)`` answers the questions a sequence operator asks --
what came before, how many so far, what was the last known value, what state has
a sequential rule reached -- in one of two physical forms:

* every key small (known from the input's size, or checked with one map-side combined
  count): ordinary windows
  partitioned by the keys, and folds over hash-partitioned sorted partitions;
* some key above ``spark.obsflow.group.rows``: the rows are range partitioned on
  (keys, order), so a large key is spread over many chunks.  Window values are
  computed inside each chunk and corrected with a summary of the chunks before
  or after it; that shuffles the rows by chunk, so before a fold each chunk is
  brought together and sorted again.  Folds run in every chunk at once and are
  repeated only for chunks whose incoming state turned out different, until
  nothing changes.  States of chunks come to the driver, so a rule whose state
  is a history of its key is run with ``chunked=False``, one key after another.

Both forms give the same rows.  ``order`` must be a total order within a key.
"""

from __future__ import annotations

import itertools
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from obsflow.plans import runtime

CHUNK = "_chunk"
# Groups of keys in which rows are counted before they are dealt.
KEY_GROUPS = 4096


@dataclass
class Op:
    """One window value: its form within a window, and how chunks combine."""

    local: Callable[[Any, Any], Column]  # (ordered window, keys) -> value
    summary: Callable[[list[str]], Column]  # (order) -> per-chunk aggregate
    carry: Callable[[Column, Any], Column]  # (summary, chunk window) -> carried value
    merge: Callable[[Column, Column], Column]  # (local value, carried) -> value
    tail: int = 0  # >0: summary only over the last `tail` rows of a chunk
    head: int = 0  # >0: summary only over the first `head` rows of a chunk


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _before(w):
    return w.rowsBetween(Window.unboundedPreceding, -1)


def _after(w):
    return w.rowsBetween(1, Window.unboundedFollowing)


def _all(w):
    return w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def running_sum(c, inclusive: bool = True) -> Op:
    c = _col(c)
    end = 0 if inclusive else -1
    return Op(
        local=lambda w, k: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, end)), F.lit(0)),
        summary=lambda o: F.sum(c),
        carry=lambda s, w: F.sum(s).over(_before(w)),
        merge=lambda v, s: v + F.coalesce(s, F.lit(0)),
    )


def row_number() -> Op:
    return Op(
        local=lambda w, k: F.row_number().over(w).cast("bigint"),
        summary=lambda o: F.count(F.lit(1)),
        carry=lambda s, w: F.sum(s).over(_before(w)),
        merge=lambda v, s: v + F.coalesce(s, F.lit(0)),
    )


def running_max(c, inclusive: bool = True) -> Op:
    c = _col(c)
    end = 0 if inclusive else -1
    return Op(
        local=lambda w, k: F.max(c).over(w.rowsBetween(Window.unboundedPreceding, end)),
        summary=lambda o: F.max(c),
        carry=lambda s, w: F.max(s).over(_before(w)),
        merge=lambda v, s: F.greatest(v, s),
    )


def running_min(c, inclusive: bool = True) -> Op:
    c = _col(c)
    end = 0 if inclusive else -1
    return Op(
        local=lambda w, k: F.min(c).over(w.rowsBetween(Window.unboundedPreceding, end)),
        summary=lambda o: F.min(c),
        carry=lambda s, w: F.min(s).over(_before(w)),
        merge=lambda v, s: F.least(v, s),
    )


def last_known(c, inclusive: bool = True) -> Op:
    """Latest non-null value at or before the row."""
    c = _col(c)
    end = 0 if inclusive else -1
    return Op(
        local=lambda w, k: F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, end)),
        summary=lambda o: F.max_by(c, F.when(c.isNotNull(), F.struct(*o))),
        carry=lambda s, w: F.last(s, ignorenulls=True).over(_before(w)),
        merge=lambda v, s: F.coalesce(v, s),
    )


def next_known(c, inclusive: bool = True) -> Op:
    """Earliest non-null value at or after the row."""
    c = _col(c)
    start = 0 if inclusive else 1
    return Op(
        local=lambda w, k: F.first(c, ignorenulls=True).over(w.rowsBetween(start, Window.unboundedFollowing)),
        summary=lambda o: F.min_by(c, F.when(c.isNotNull(), F.struct(*o))),
        carry=lambda s, w: F.first(s, ignorenulls=True).over(_after(w)),
        merge=lambda v, s: F.coalesce(v, s),
    )


def total(agg: Callable[[Column], Column], c, merge: Callable[[Column], Column] | None = None) -> Op:
    """Whole-key aggregate on every row; ``merge`` combines partial results."""
    c = _col(c)
    return Op(
        local=lambda w, k: agg(c).over(k),
        summary=lambda o: agg(c),
        carry=lambda s, w: (merge or agg)(s).over(_all(w)),
        merge=lambda v, s: F.coalesce(s, v),
    )


def count_all() -> Op:
    return total(lambda c: F.count(c), F.lit(1), merge=F.sum)


def _last_n(values: Column, n: int) -> Column:
    size = F.size(values)
    return F.when(size > n, F.slice(values, F.greatest(size - n + 1, F.lit(1)), n)).otherwise(values)


def before(c, n: int) -> Op:
    """Array of up to ``n`` structs(v) preceding the row, oldest first."""
    s = F.struct(_col(c).alias("v"))
    return Op(
        local=lambda w, k: F.collect_list(s).over(w.rowsBetween(-n, -1)),
        summary=lambda o: F.transform(
            F.array_sort(F.collect_list(F.when(F.col("_tail") <= n, F.struct((-F.col("_tail")).alias("p"), s.alias("s"))))),
            lambda x: x["s"],
        ),
        carry=lambda x, w: F.flatten(F.collect_list(x).over(w.rowsBetween(-n, -1))),
        merge=lambda v, x: F.when(x.isNull() | (F.size(v) >= n), v).otherwise(_last_n(F.concat(x, v), n)),
        tail=n,
    )


def after(c, n: int) -> Op:
    """Array of up to ``n`` structs(v) following the row, nearest first."""
    s = F.struct(_col(c).alias("v"))
    return Op(
        local=lambda w, k: F.collect_list(s).over(w.rowsBetween(1, n)),
        summary=lambda o: F.transform(
            F.array_sort(F.collect_list(F.when(F.col("_head") <= n, F.struct(F.col("_head").alias("p"), s.alias("s"))))),
            lambda x: x["s"],
        ),
        carry=lambda x, w: F.flatten(F.collect_list(x).over(w.rowsBetween(1, n))),
        merge=lambda v, x: F.when(x.isNull() | (F.size(v) >= n), v).otherwise(F.slice(F.concat(v, x), 1, n)),
        head=n,
    )


class _Shift(Op):
    pass


def lag(c, n: int = 1) -> Op:
    c = _col(c)
    b = before(c, n)
    op = _Shift(b.local, b.summary, b.carry, b.merge, tail=n)
    op.direct = lambda w: F.lag(c, n).over(w)
    op.pick = lambda arr: F.when(F.size(arr) >= n, arr[0]["v"])
    return op


def lead(c, n: int = 1) -> Op:
    c = _col(c)
    a = after(c, n)
    op = _Shift(a.local, a.summary, a.carry, a.merge, head=n)
    op.direct = lambda w: F.lead(c, n).over(w)
    op.pick = lambda arr: F.when(F.size(arr) >= n, arr[n - 1]["v"])
    return op


class Fold:
    """A sequential rule over one key's rows in order.

    ``core`` is a small comparable state; ``acc`` is a list of integer totals that
    only ever grow by amounts which do not depend on their own value.  Emitted
    tuples follow ``schema`` (the keys are put in front of them).
    """

    schema = ""
    counters = 0

    def start(self):
        return None

    def step(self, core, acc, row, emit):
        raise NotImplementedError

    def finish(self, core, acc, emit):
        return None


class Ordered:
    def __init__(self, df: DataFrame, keys: list[str], order: list[str], *, chunked: bool | None = None, rows: int = 0):
        """``rows``: of the frame where ``chunked`` is known to be False and the frame is not yet dealt by the keys."""
        self.keys, self.order = list(keys), list(order)
        spark = df.sparkSession
        self.bound = runtime.group_rows(spark)
        if chunked is None:
            largest, rows = _sizes(df, self.keys)
            chunked = largest > self.bound
            if chunked:
                parts = max(2, spark.sparkContext.defaultParallelism, -(-rows // runtime.chunk_rows(spark)))
                df = _chunks(df, self.keys, self.order, parts)
        if not chunked:
            df = spread(df, self.keys, rows)
        # Whether rows have left the partition of their chunk.
        self.df, self.chunked, self.moved = df, chunked, False

    def _same(self, df: DataFrame) -> Ordered:
        out = Ordered.__new__(Ordered)
        out.keys, out.order, out.bound, out.chunked, out.moved, out.df = self.keys, self.order, self.bound, self.chunked, self.moved, df
        return out

    @property
    def fewer(self) -> bool | None:
        """``chunked`` for a frame with no more rows per key than this one: known to be
        small when this one is, otherwise to be checked again."""
        return None if self.chunked else False

    @property
    def result(self) -> DataFrame:
        return self.df.drop(CHUNK) if self.chunked else self.df

    def where(self, cond: Column) -> Ordered:
        return self._same(self.df.filter(cond))

    def columns(self, **exprs) -> Ordered:
        """Row-local columns; keeps keys, order and chunks."""
        return self._same(self.df.withColumns({n: _col(c) for n, c in exprs.items()}))

    def select(self, *cols) -> Ordered:
        names = [c for c in self.keys + self.order if c not in cols] + list(cols)
        if self.chunked:
            names.append(CHUNK)
        return self._same(self.df.select(*names))

    def with_columns(self, **ops: Op) -> Ordered:
        if not self.chunked:
            w = Window.partitionBy(*self.keys).orderBy(*self.order)
            k = Window.partitionBy(*self.keys)
            return self._same(self.df.withColumns({
                n: op.direct(w) if isinstance(op, _Shift) else op.local(w, k) for n, op in ops.items()
            }))
        by = self.keys + [CHUNK]
        w = Window.partitionBy(*by).orderBy(*self.order)
        k = Window.partitionBy(*by)
        df = self.df
        if any(op.tail for op in ops.values()):
            back = Window.partitionBy(*by).orderBy(*[F.desc(o) for o in self.order])
            df = df.withColumn("_tail", F.row_number().over(back))
        if any(op.head for op in ops.values()):
            df = df.withColumn("_head", F.row_number().over(w))
        summary = df.groupBy(*by).agg(*[op.summary(self.order).alias(f"_s_{n}") for n, op in ops.items()])
        chain = Window.partitionBy(*self.keys).orderBy(CHUNK)
        carried = summary.withColumns({f"_c_{n}": op.carry(F.col(f"_s_{n}"), chain) for n, op in ops.items()})
        # Only keys that cross a chunk border need a correction: at most two rows per chunk.
        carried = carried.withColumn("_span", F.count(F.lit(1)).over(Window.partitionBy(*self.keys)))
        carried = carried.filter("_span > 1").select(*by, *[f"_c_{n}" for n in ops])
        df = df.withColumns({f"_v_{n}": op.local(w, k) for n, op in ops.items()})
        right = runtime.small(runtime.checkpoint(carried.select(*[F.col(b).alias(f"_r_{b}") for b in by], *[f"_c_{n}" for n in ops])))
        cond = F.lit(True)
        for b in by:
            cond = cond & df[b].eqNullSafe(right[f"_r_{b}"])
        df = df.join(right, cond, "left")
        for n, op in ops.items():
            value = op.merge(F.col(f"_v_{n}"), F.col(f"_c_{n}"))
            df = df.withColumn(n, op.pick(value) if isinstance(op, _Shift) else value)
        keep = [c for c in df.columns if not c.startswith(("_v_", "_c_", "_r_")) and c not in ("_tail", "_head")]
        out = self._same(df.select(*keep))
        out.moved = True
        return out

    def fold(self, fold: Fold, cols: list[str]) -> DataFrame:
        """Run a sequential rule; the result has the keys and the fold's columns."""
        cols = list(cols)
        if not self.chunked and self.keys:
            # The window asks for the keys together and in order, so a fold after other
            # windows of this object needs neither another shuffle nor another sort.
            w = Window.partitionBy(*self.keys).orderBy(*self.order)
            src = self.df.withColumn("_seq", F.row_number().over(w)).select(*self.keys, *cols, "_seq")
        else:
            tail = [CHUNK] if self.chunked else []
            src = self.df.select(*self.keys, *cols, *tail, *[o for o in self.order if o not in cols and o not in self.keys])
            if self.chunked and self.moved:
                src = runtime.checkpoint(src.repartition(CHUNK).sortWithinPartitions(CHUNK, *self.keys, *self.order))
        key_fields = [src.schema[k] for k in self.keys]
        schema = T.StructType(key_fields + T.StructType.fromDDL(fold.schema).fields)
        arrow = to_arrow_schema(schema)
        nk, nc = len(self.keys), len(cols)
        if self.chunked:
            return _chunk_fold(src, fold, nk, nc, schema, arrow)
        if not self.keys:
            src = src.repartition(1).sortWithinPartitions(*self.order)
        return src.mapInArrow(_runner(fold, nk, nc, arrow), schema)


def spread(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """Rows of a key together, in partitions of bounded size where there are many rows.

    Adaptive execution merges partitions by their compressed bytes; narrow sorted columns
    shrink so much that a task would sort tens of millions of rows in memory.
    """
    parts = _parts(df.sparkSession, rows)
    return df.repartition(parts, *keys) if keys and parts else df


def _parts(spark, rows: int) -> int:
    parts, direct = -(-rows // runtime.task_rows(spark)), runtime.direct_parts(spark)
    if direct < parts <= direct + direct // 4:
        # Up to a quarter more rows a task, where those who deal them need not sort their file split for it.
        parts = direct
    return max(parts, spark.sparkContext.defaultParallelism) if parts > 1 else 0


def sized(df: DataFrame, keys: list[str]) -> tuple[bool | None, int]:
    """``chunked`` to use for several steps over ``df`` and its rows: one check instead of one per step."""
    largest, rows = _sizes(df, keys)
    return (False, rows) if largest <= runtime.group_rows(df.sparkSession) else (None, rows)


def fits(df: DataFrame, keys: list[str]) -> bool | None:
    return sized(df, keys)[0]


@dataclass
class Deal:
    """How frames over the same keys are dealt: in ``parts`` partitions by key, 0 where Spark decides."""

    chunked: bool | None
    parts: int = 0

    def of(self, df: DataFrame, keys: list[str]) -> DataFrame:
        """Another frame dealt the same way, to be joined without moving the first one again."""
        return df.repartition(self.parts, *keys) if self.parts else df

    def join(self, left: DataFrame, right: DataFrame, keys: list[str], more: list[str], how: str = "inner") -> DataFrame:
        """Join by the keys and more columns, which Spark shuffles by all of them; the result is dealt by the keys again."""
        on = [*keys, *more]
        return self.of(self.of(left, on).join(self.of(right, on), on, how), keys)


def dealt(df: DataFrame, keys: list[str], deal: Deal | None = None) -> tuple[DataFrame, Deal]:
    """``df`` dealt by its keys once for several steps over it.

    Windows, aggregates by the keys and more columns, and joins of frames made from the
    result find the rows of a key together and need no further shuffle.  A frame with a
    large key is left as it is, and so is one whose maker knows its ``deal``.
    """
    if deal is not None:
        return df, deal
    (df,), deal = dealt_together([df], keys)
    return df, deal


def dealt_together(frames: list[DataFrame | None], keys: list[str]) -> tuple[list[DataFrame | None], Deal]:
    """Frames dealt alike by the same keys, or all left as they are where one has a large key."""
    sizes = [sized(d, keys) for d in frames if d is not None]
    small = all(chunked is False for chunked, _ in sizes)
    session = next(d for d in frames if d is not None).sparkSession
    deal = Deal(False, _parts(session, max(rows for _, rows in sizes))) if small and keys else Deal(False if small else None)
    return [None if d is None else deal.of(d, keys) for d in frames], deal


def _sizes(df: DataFrame, keys: list[str]) -> tuple[int, int]:
    """Rows of the largest key and of the whole frame, or an upper bound of both.

    Where no step can add rows and the input files together have no more rows than one key
    may have, only their footers are read; else rows are counted in groups of keys by a hash,
    which takes the same memory whatever the number of keys, and by key only in groups that
    hold more rows than one key may have.  The answer steers the physical form, never the result.
    """
    bound = runtime.group_rows(df.sparkSession)
    total_rows = runtime.file_rows(df)
    if total_rows is not None and total_rows <= bound:
        return total_rows, total_rows

    def largest(frame: DataFrame, by: list[Column | str]) -> tuple[int, int]:
        row = frame.groupBy(*by).agg(F.count(F.lit(1)).alias("_size")).agg(F.max("_size"), F.sum("_size")).first()
        return (row[0] or 0, row[1] or 0)

    if not keys:
        return largest(df, [])
    group = F.pmod(F.xxhash64(*keys), F.lit(KEY_GROUPS)).alias("_group")
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_size")).collect()
    rows, heavy = sum(r[1] for r in sizes), [r[0] for r in sizes if r[1] > bound]
    if not heavy:
        return max((r[1] for r in sizes), default=0), rows
    return largest(df if len(heavy) == len(sizes) else df.filter(group.isin(heavy)), keys)[0], rows


def _chunks(df: DataFrame, keys: list[str], order: list[str], parts: int) -> DataFrame:
    """Range partition on the total order and fix the chunk of every row."""
    df = df.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)
    return runtime.checkpoint(df.withColumn(CHUNK, F.spark_partition_id()))


def _runner(fold: Fold, nk: int, nc: int, arrow: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        key, core, acc = None, None, None

        def emit(*values):
            out.append(key + values)

        for batch in batches:
            for this, row in _rows(batch, nk, nc):
                if this != key or acc is None:
                    if acc is not None:
                        fold.finish(core, acc, emit)
                    key, core, acc = this, fold.start(), [0] * fold.counters
                core = fold.step(core, acc, row, emit)
            if len(out) >= 4096:
                yield _batch(out, arrow)
                out.clear()
        if acc is not None:
            fold.finish(core, acc, emit)
        if out:
            yield _batch(out, arrow)

    return run


def _rows(batch: pa.RecordBatch, nk: int, nc: int):
    """(key, values) of every row of a batch."""
    cols = [c.to_pylist() for c in batch.columns[: nk + nc]]
    keys = zip(*cols[:nk]) if nk else itertools.repeat((), batch.num_rows)
    return zip(keys, zip(*cols[nk:]))


def _batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow)], schema=arrow)


def _chunk_fold(src: DataFrame, fold: Fold, nk: int, nc: int, schema, arrow) -> DataFrame:
    """Fold every chunk at once, then redo the chunks whose incoming state differed."""

    # A partition holds whole chunks, one after the other.
    def states(incoming: dict[int, bytes]):
        def run(batches):
            chunk = first = key = core = acc = None

            def state():
                return pa.RecordBatch.from_arrays(
                    [pa.array([chunk], pa.int32()), pa.array([pickle.dumps((first, key, core, acc))], pa.binary())],
                    names=[CHUNK, "state"],
                )

            for batch in batches:
                for at, (this, row) in zip(batch.column(nk + nc).to_pylist(), _rows(batch, nk, nc)):
                    if chunk != at:
                        if chunk is not None:
                            yield state()
                        chunk, first, key = at, this, this
                        core = pickle.loads(incoming[chunk]) if chunk in incoming else fold.start()
                        acc = [0] * fold.counters
                    elif this != key:
                        key, core, acc = this, fold.start(), [0] * fold.counters
                    core = fold.step(core, acc, row, _ignore)
            if chunk is not None:
                yield state()

        return run

    # One compact state per chunk comes back; the rows never do.
    ends: dict[int, tuple] = {}
    incoming: dict[int, bytes] = {}
    untouched = pickle.dumps(fold.start())
    todo: list[int] | None = None
    while todo is None or todo:
        part = src if todo is None else src.filter(F.col(CHUNK).isin(todo))
        for r in part.mapInArrow(states(incoming), f"{CHUNK} int, state binary").collect():
            ends[r[0]] = pickle.loads(r[1])
        order = sorted(ends)
        todo = []
        for a, b in zip(order, order[1:]):
            if ends[a][1] == ends[b][0]:
                if pickle.loads(incoming.get(b, untouched)) != ends[a][2]:
                    todo.append(b)
                incoming[b] = pickle.dumps(ends[a][2])
    # Totals: prefix sums along the chunks a key spans.
    totals: dict[int, list[int]] = {}
    closed: set[int] = set()
    order = sorted(ends)
    for a, b in zip(order, order[1:]):
        if ends[a][1] == ends[b][0]:
            base = totals.get(a, [0] * fold.counters) if ends[a][0] == ends[a][1] else [0] * fold.counters
            totals[b] = [x + y for x, y in zip(base, ends[a][3])]
        else:
            closed.add(a)
    if order:
        closed.add(order[-1])

    def run(batches):
        out: list[tuple] = []
        chunk = key = core = acc = None

        def emit(*values):
            out.append(key + values)

        for batch in batches:
            for at, (this, row) in zip(batch.column(nk + nc).to_pylist(), _rows(batch, nk, nc)):
                if chunk != at:
                    if chunk in closed:
                        fold.finish(core, acc, emit)
                    chunk, key = at, this
                    core = pickle.loads(incoming[chunk]) if chunk in incoming else fold.start()
                    acc = list(totals.get(chunk, [0] * fold.counters))
                elif this != key:
                    fold.finish(core, acc, emit)
                    key, core, acc = this, fold.start(), [0] * fold.counters
                core = fold.step(core, acc, row, emit)
            if len(out) >= 4096:
                yield _batch(out, arrow)
                out.clear()
        if chunk in closed:
            fold.finish(core, acc, emit)
        if out:
            yield _batch(out, arrow)

    return src.mapInArrow(run, schema)


def _ignore(*_):
    return None


def best(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """First row per key by a total order, as a map-side combined aggregate."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*[_col(o) for o in order])).alias("_picked"))
    return picked.select(*keys, *[F.col("_picked")[c].alias(c) for c in rest])


def exact_median(df: DataFrame, keys: list[str], value: str, name: str, tie: list[str]) -> DataFrame:
    """Exact median per key from ranks, so a large key is not gathered in one place."""
    o = Ordered(df.filter(F.col(value).isNotNull()).select(*keys, value, *tie), keys, [value, *tie])
    o = o.with_columns(_rn=row_number(), _n=count_all())
    mid = o.result.filter((F.col("_rn") == F.floor((F.col("_n") + 1) / 2)) | (F.col("_rn") == F.floor(F.col("_n") / 2) + 1))
    return mid.groupBy(*keys).agg(F.avg(value).alias(name))
