"""Lookups by key, content or time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsflow.plans import runtime
from obsflow.plans.ordered import Ordered, best, last_known, next_known
from obsflow.plans.ranges import cell_join


def asof_lookup(left: DataFrame, right: DataFrame, keys, order, tie, values, direction="before", *, chunked=None) -> DataFrame:
    """Nearest strictly earlier (or later) row of ``right`` for every row of ``left``.

    The two sides are put in one sequence per key, so the work is linear; ``order`` is
    the compared column and ``tie`` makes rows of one side distinct.
    """
    near = direction == "before"
    a = left.withColumns({"_side": F.lit(0 if near else 1), "_hit": F.lit(None).cast(_struct(right, values))})
    b = right.withColumns({"_side": F.lit(1 if near else 0), "_hit": F.struct(*values)})
    both = a.unionByName(b.select(*keys, order, *tie, "_side", "_hit"), allowMissingColumns=True)
    op = last_known("_hit", inclusive=False) if near else next_known("_hit", inclusive=False)
    o = Ordered(both, keys, [order, "_side", *tie], chunked=chunked).with_columns(_got=op)
    out = o.result.filter(F.col("_side") == (0 if near else 1))
    return out.select(*left.columns, *[F.col("_got")[v].alias(f"{direction}_{v}") for v in values])


def _struct(df: DataFrame, values):
    return df.select(F.struct(*values).alias("s")).schema["s"].dataType


def referential_gaps(df: DataFrame, ref: DataFrame, on: list[str]) -> DataFrame:
    """Distinct referenced ids with no match."""
    return df.select(*on).distinct().join(ref.select(*on), on, "left_anti")


def cache_hits(df: DataFrame, cache: DataFrame, digest: str) -> DataFrame:
    return df.join(cache.select(digest).distinct(), digest, "left_semi")


def cache_misses(df: DataFrame, cache: DataFrame, digest: str) -> DataFrame:
    return df.join(cache.select(digest).distinct(), digest, "left_anti")


def rate_lookup(df: DataFrame, rates: DataFrame, model: str) -> DataFrame:
    """Price columns of each request's model; an unknown model is marked as an error."""
    out = df.join(runtime.small(rates.withColumn("_known", F.lit(True))), model, "left")
    return out.withColumn("error", F.when(F.col("_known").isNull(), F.concat(F.lit("unknown model "), F.col(model)))).drop("_known")


def range_assign(left: DataFrame, right: DataFrame, keys, row: list[str], reach: tuple[Column, Column, Column, Column],
                 cell: float, cost: Column, order: list[str], limit: float) -> DataFrame:
    """Cheapest match (``order`` columns and cost) of every left row among right rows within reach.

    ``reach`` gives the closed intervals (left from, left to, right from, right to) that
    must meet; the best match is kept by a map-side combined minimum.
    """
    pairs = cell_join(left, right, keys, *reach, cell).withColumn("cost", cost).filter(F.col("cost") <= limit)
    return best(pairs.select(*keys, *row, *order, "cost"), [*keys, *row], ["cost", *order])


def override_lookup(df: DataFrame, overrides: DataFrame, identity: list[str], length: int = 24) -> DataFrame:
    """Exception attached to the content of an item; anchors of changed items match nothing."""
    out = df.withColumn("anchor", F.substring(F.sha2(F.to_json(F.struct(*identity)), 256), 1, length))
    return out.join(overrides.select("anchor", "target"), "anchor", "left")


def best_variant(df: DataFrame, keys, pref: list[str], height: str, audio: str, wanted_height: Column, wanted_audio: Column) -> DataFrame:
    """First variant in preference order that is tall enough and has sound if asked."""
    ok = (F.col(height) >= wanted_height) & (~wanted_audio | F.col(audio))
    return best(df.filter(ok), keys, pref)
