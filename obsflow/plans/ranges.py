"""Row generation and interval matching without unbounded arrays or pairings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 4096


def explode_range(df: DataFrame, name: str, first: Column, last: Column) -> DataFrame:
    """One row per integer in first..last (none when last < first), in blocks of bounded size."""
    df = df.withColumns({"_a": first.cast("bigint"), "_z": last.cast("bigint")}).filter("_z >= _a")
    df = df.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_z") - F.col("_a")) / BLOCK).cast("bigint"))))
    lo = F.col("_a") + F.col("_b") * BLOCK
    df = df.withColumn(name, F.explode(F.sequence(lo, F.least(F.col("_z"), lo + BLOCK - 1))))
    return df.drop("_a", "_z", "_b")


def _places(df: DataFrame, k: str, i: str, first: Column, last: Column, top: Column, points: int) -> DataFrame:
    """Dyadic places of cells: (kind, level, index).

    Kind ``points``: the cell ``first`` and all that hold it, up to level ``top``.  The other
    kind: the fewest places that together are the cells of the interval, ``first`` on if
    points have kind 1, after it if they have kind 0; two at most on each level.
    """
    shift = lambda c, n: F.call_function("shiftright", c, n)
    start = first + 1 - points
    widest = F.floor(F.log2(F.greatest(last - start + 1, F.lit(1)).cast("double"))).cast("int")
    n = F.col(k)
    # Of the cells from low up to high: an odd end has no sibling inside.
    low, high = -shift(-start, n), shift(last + 1, n)
    within = (n <= widest) & (low < high)
    place = lambda t, at: F.struct(F.lit(t).alias("_t"), at.alias(i))
    found = F.array(F.when(n <= F.col("_top"), place(points, shift(first, n))), F.when(within & (F.pmod(low, F.lit(2)) == 1), place(1 - points, low)),
                    F.when(within & (F.pmod(high, F.lit(2)) == 1), place(1 - points, high - 1)))
    columns = df.columns
    df = df.withColumn("_top", top)
    df = df.withColumn(k, F.explode(F.sequence(F.lit(0), F.greatest("_top", widest))))
    return df.withColumn("_place", F.explode(F.array_compact(found))).select(*columns, k, "_place.*")


def cell_join(left: DataFrame, right: DataFrame, keys: list[str], l0: Column, l1: Column, r0: Column, r1: Column, cell: float) -> DataFrame:
    """Pairs of the same key whose closed intervals meet, joined on dyadic places of cells of width ``cell``.

    Two intervals meet where the start of the left one lies in the right one, or the start
    of the right one behind it in the left one.  An interval is cut into few places, a start
    has the places around it, so a row becomes as many rows as the logarithm of the longest
    interval, and each pair is found once.  Key and place together spread a large key over
    the cluster.
    """
    a = left.withColumns({"_lx": l0, "_ly": l1}).withColumns({"_l0": F.floor(F.col("_lx") / cell).cast("bigint"), "_l1": F.floor(F.col("_ly") / cell).cast("bigint")}).filter("_lx <= _ly")
    b = right.withColumns({"_rx": r0, "_ry": r1}).withColumns({"_r0": F.floor(F.col("_rx") / cell).cast("bigint"), "_r1": F.floor(F.col("_ry") / cell).cast("bigint")}).filter("_rx <= _ry")
    top = lambda d, x, y: d.agg(F.coalesce(F.floor(F.log2(F.max(F.col(y) - F.col(x) + 1).cast("double"))), F.lit(0)).cast("int")).scalar()
    a = _places(a, "_k", "_i", F.col("_l0"), F.col("_l1"), top(b, "_r0", "_r1"), 0)
    b = _places(b, "_k", "_i", F.col("_r0"), F.col("_r1"), top(left.select(F.floor(l0 / cell).cast("bigint").alias("_l0"), F.floor(l1 / cell).cast("bigint").alias("_l1")).filter("_l1 >= _l0"), "_l0", "_l1"), 1)
    out = a.join(b, [*keys, "_t", "_k", "_i"])
    out = out.filter((F.col("_lx") <= F.col("_ry")) & (F.col("_rx") <= F.col("_ly")))
    return out.drop("_t", "_k", "_i", "_l0", "_l1", "_lx", "_ly", "_r0", "_r1", "_rx", "_ry")
