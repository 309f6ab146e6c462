"""Streaming forms of the sequential operators.

The same rules that run as folds over stored streams run here over unbounded ones: the
state of a rule is kept per key, rows are folded in event order once the watermark has
passed them, and a key that has been idle is finished.  Rows later than the watermark are
dropped; watermark and idle limit are additions of the streaming form.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from obsflow.operators.sequence import _Hold, _Views, absolute_difference
from obsflow.plans.ordered import Fold

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FoldState:
    """A fold in event-time order, however rows are spread over triggers.

    Rows wait in the state until the watermark has passed them; then no earlier row can come
    any more (it would be dropped as late), and what waited is folded, in order.  A key
    whose next row is more than ``idle_ms`` after its last one, or whose last row is that
    far behind the watermark, is finished: the fold starts anew, its totals go on.  So the
    result depends on the rows that were in time, not on triggers.  The state of a key is
    one value that travels with its rows, so a key costs no calls of its own.
    """

    def __init__(self, fold: Fold, columns: list[str], cols: list[str], order: list[str], event_ms: str, idle_ms: int):
        self.fold, self.columns, self.cols, self.order = fold, columns, cols, order
        self.event_ms, self.idle_ms = event_ms, idle_ms

    def __call__(self, key: tuple, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        # Core, totals, last event time or None after an end, rows that wait.
        core, acc, last, waiting = pickle.loads(state.get[0]) if state.exists else (self.fold.start(), [0] * self.fold.counters, None, [])
        if not state.hasTimedOut:
            for pdf in pdfs:
                order, values = (_tuples(pdf, c) for c in (self.order, self.cols))
                waiting += zip(pdf[self.event_ms].tolist(), order, values, strict=True)
        now = state.getCurrentWatermarkMs()
        out: list[tuple] = []
        emit = lambda *v: out.append(v)
        ready, rest = [r for r in waiting if r[0] <= now], [r for r in waiting if r[0] > now]
        for at, _, row in sorted(ready, key=lambda r: (r[0], [(v is not None, v) for v in r[1]])):
            if last is not None and at - last > self.idle_ms:
                self.fold.finish(core, acc, emit)
                core = self.fold.start()
            core, last = self.fold.step(core, acc, row, emit), at
        if last is not None and last + self.idle_ms <= now:
            self.fold.finish(core, acc, emit)
            core, last = self.fold.start(), None
        due = min((r[0] for r in rest), default=None)
        if last is not None:
            due = last + self.idle_ms if due is None else min(due, last + self.idle_ms)
        if due is None and not any(acc):
            state.remove()
        else:
            state.update((pickle.dumps((core, acc, last, rest)),))
        if due is not None:
            # A timeout comes when the watermark is behind it; rows at the watermark are due.
            state.setTimeoutTimestamp(max(1, due - 1))
        if out:
            yield pd.DataFrame([(*key, *r) for r in out], columns=self.columns).astype(object)


def _tuples(pdf: pd.DataFrame, cols: list[str]) -> Iterator[tuple]:
    """Rows of some columns as plain values, None where one is missing."""
    lists = [pdf[c].tolist() for c in cols]
    return zip(*[[None if _missing(v) else v for v in x] for x in lists])


def _missing(v) -> bool:
    return v is None or (isinstance(v, float) and v != v)


def fold_stream(df: DataFrame, keys, order, cols, fold: Fold, event_time: str, watermark: str, idle_ms: int) -> DataFrame:
    """Run a fold over a streaming frame (RocksDB state store, append output).

    Rows without an event time are dropped.  The rows of one key that wait for the
    watermark are read together when it moves on; totals of a key that has ended are kept.
    """
    src = df.filter(F.col(event_time).isNotNull()).withWatermark(event_time, watermark).withColumn("event_ms", F.unix_millis(event_time))
    names = list(dict.fromkeys([*keys, *cols, *order, "event_ms", event_time]))
    schema = T.StructType([df.schema[k] for k in keys] + T.StructType.fromDDL(fold.schema).fields)
    run = FoldState(fold, schema.names, list(cols), list(order), "event_ms", idle_ms)

    # Spark asks for a plain function.
    def step(key, pdfs, state):
        yield from run(key, pdfs, state)

    return src.select(*names).groupBy(*keys).applyInPandasWithState(step, schema, "data binary", "append", GroupStateTimeout.EventTimeTimeout)


def stable_views_stream(df: DataFrame, keys, order, t: str, sig: str, threshold, interval, *, event_time: str, watermark: str,
                        idle_ms: int, k: int = 2, diff=absolute_difference, content=None) -> DataFrame:
    """Views of at least ``k`` samples, emitted when the view closes or its stream falls idle."""
    kind = df.schema[sig].dataType.simpleString()
    fold = _Views(threshold, interval, None, diff, content or _always, kind)
    return fold_stream(df, keys, order, [t, sig], fold, event_time, watermark, idle_ms).filter(F.col("count") >= k)


def _always(_):
    return True


def hold_dedup_stream(df: DataFrame, keys, order, t: str, fingerprint: str, heartbeat: float, *, event_time: str, watermark: str, idle_ms: int) -> DataFrame:
    """Collapse holds as they arrive; the row held back is released by the next change or the timer."""
    keep = list(dict.fromkeys([*order, t, fingerprint]))
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    src = df.withColumn("dedup_on", F.lit(True))
    return fold_stream(src, keys, order, [t, fingerprint, "dedup_on", *keep], _Hold(heartbeat, keep, schema), event_time, watermark, idle_ms)


def hold_sessions(df: DataFrame, keys, event_time: str, gap: str, watermark: str) -> DataFrame:
    """Holds as sessions that end after an idle gap."""
    out = df.withWatermark(event_time, watermark).groupBy(*keys, F.session_window(event_time, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def usage_rollup_stream(df: DataFrame, keys, event_time: str, every: str, watermark: str, sums: list[str]) -> DataFrame:
    """Counters per tumbling window."""
    out = df.withWatermark(event_time, watermark).groupBy(*keys, F.window(event_time, every).alias("w")).agg(
        F.count(F.lit(1)).alias("requests"), *[F.sum(c).alias(c) for c in sums])
    return out.select(*keys, F.col("w.start").alias("start"), "requests", *sums)


def progress_stream(df: DataFrame, keys, event_time: str, tie: list[str], phase: str, completed: str, total: str, *,
                    every: str | None = None, watermark: str | None = None) -> DataFrame:
    """Latest report per job, as updates; with ``every`` the last report of each window, once it is complete."""
    if every is not None:
        out = df.withWatermark(event_time, watermark).groupBy(*keys, F.window(event_time, every).alias("w")).agg(
            F.max_by(F.struct(phase, completed, total), F.struct(event_time, *tie)).alias("l"))
        return out.select(*keys, F.col("w.start").alias("start"), F.col("l")[phase].alias("phase"), F.col("l")[completed].alias("completed"), F.col("l")[total].alias("total"))
    out = df.groupBy(*keys).agg(F.max_by(F.struct(phase, completed, total), F.struct(event_time, *tie)).alias("l"), F.max(event_time).alias("updated"))
    return out.select(*keys, F.col("l")[phase].alias("phase"), F.col("l")[completed].alias("completed"), F.col("l")[total].alias("total"), "updated")


def bar_votes_stream(df: DataFrame, keys, cell: str, event_time: str, watermark: str, bucket: Column, every: str, visible: Column, ink: Column) -> DataFrame:
    """Votes per window, one per cell and bucket."""
    d = df.withColumns({"_bucket": bucket, "_v": visible, "_s": visible & ink}).withWatermark(event_time, watermark)
    d = d.dropDuplicatesWithinWatermark([*keys, cell, "_bucket"])
    g = d.groupBy(*keys, cell, F.window(event_time, every).alias("w")).agg(F.count_if("_v").alias("clear"), F.count_if("_s").alias("support"))
    return g.select(*keys, cell, F.col("w.start").alias("start"), "clear", "support")
