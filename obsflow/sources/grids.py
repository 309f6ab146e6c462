"""Time grids over streams and stream descriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsflow.plans.ordered import Ordered, lag, lead, total
from obsflow.plans.ranges import explode_range


def sample_grid(df: DataFrame, keys, order, t: str, interval: float, start: float = 0.0, end: float | None = None) -> DataFrame:
    """The latest sample at every grid time ``start + k*interval`` before the end.

    Each sample serves the grid times up to the next sample, so no stream is gathered:
    the grid is produced where the samples are.  Grid times before a stream's first
    sample carry nulls.
    """
    if not 0.1 <= interval <= 10 * 86400:
        raise ValueError("interval must be at least 0.1 s")
    if start < 0 or (end is not None and not start < end):
        raise ValueError("start must be non-negative and before end")
    payload = [c for c in df.columns if c not in keys]
    o = Ordered(df, keys, order).with_columns(_next=lead(t), _prev=lag(t), _dur=total(F.max, t))
    stop = F.col("_dur") if end is None else F.least(F.col("_dur"), F.lit(float(end)))
    lead_in = F.col("_prev").isNull()
    lo = F.when(lead_in, F.lit(0)).otherwise(F.greatest(F.lit(0), F.floor((F.col(t) - start) / interval) - 1))
    hi = F.ceil((F.least(F.coalesce(F.col("_next"), stop), stop) - start) / interval) + 1
    g = explode_range(o.result.withColumn("_stop", stop), "k", lo, hi)
    g = g.withColumn("grid_t", F.lit(float(start)) + F.col("k") * F.lit(float(interval)))
    held = (F.col("grid_t") >= F.col(t)) & (F.col("_next").isNull() | (F.col("grid_t") < F.col("_next")))
    early = F.col("_prev").isNull() & (F.col("grid_t") < F.col(t))
    g = g.filter((held | early) & (F.col("grid_t") < F.col("_stop")))
    return g.select(*keys, "k", "grid_t", *[F.when(held, F.col(c)).alias(c) for c in payload])


def stream_metadata(frames: DataFrame, keys, w: Column, h: Column, fps: Column) -> DataFrame:
    """Size and duration of each stream; streams with any non-positive value are left out."""
    out = frames.groupBy(*keys).agg(
        F.max(w).alias("width"), F.max(h).alias("height"), (F.count(F.lit(1)) / F.max(fps)).alias("duration"))
    return out.filter("width > 0 and height > 0 and duration > 0")


def overview_times(streams: DataFrame, duration: str) -> DataFrame:
    """Times of a first look at each stream: near both ends and at the quarters."""
    d = F.col(duration)
    at = F.array(F.least(F.lit(0.2), d / 2), F.least(F.lit(3.0), d / 2), d * 0.25, d * 0.5, d * 0.75,
                 F.greatest(F.lit(0.0), d - 3), F.greatest(F.lit(0.0), d - 0.2))
    return streams.withColumn("t", F.explode(F.array_sort(F.array_distinct(at))))


def tail_anchored_grid(streams: DataFrame, duration: str, interval: float) -> DataFrame:
    """Grid below ``duration - 0.2``, then that time itself, once."""
    d = F.col(duration)
    n = F.floor((d - 0.2) / interval) + 1
    g = explode_range(streams, "k", F.lit(0), F.greatest(n, F.lit(0)))
    g = g.withColumn("t", F.col("k") * F.lit(float(interval))).filter(F.col("t") < d - 0.2)
    tail = streams.withColumns({
        "k": F.greatest(F.ceil((d - 0.2) / interval), F.lit(0)).cast("bigint"), "t": F.greatest(F.lit(0.0), d - 0.2)})
    return g.unionByName(tail)


def corpus_report(lines: DataFrame, pages: DataFrame, warnings: DataFrame, keys) -> DataFrame:
    """Lines, pages and warnings per stream, each counted before they are brought together."""
    parts = [lines.select(*keys, F.lit("l").alias("_k")), pages.select(*keys, F.lit("p").alias("_k")),
             warnings.select(*keys, F.lit("w").alias("_k"))]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    out = both.groupBy(*keys).agg(*[F.count_if(F.col("_k") == k).alias(n)
                                    for k, n in (("l", "n_lines"), ("p", "n_pages"), ("w", "n_warnings"))])
    return out.filter("n_lines > 0")
