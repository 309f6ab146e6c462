"""Difference measures between rasters, rows and vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsflow.plans import runtime
from obsflow.plans.ordered import Ordered, lag, row_number, running_sum

# Templates that others are measured against.
PIVOTS = 32


def ink_bitmap(raster: Column, w: int, h: int, level: int = 150, border: int = 3) -> Column:
    """1 where a cell is darker than ``level``, 0 elsewhere and in the border."""
    def cell(v, i):
        x, y = i % w, F.floor(i / w)
        inside = (x >= border) & (x < w - border) & (y >= border) & (y < h - border)
        return F.when(inside & (v < level), 1).otherwise(0)

    return F.transform(raster, cell)


# Columns of a strip, which divides the tiles, and columns of its neighbours on each side.
STRIP, HALO = 50, 3


def _or(*planes: Column) -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b), planes)


def _strips(ink: Column, w: int, h: int) -> Column:
    """Bit planes of a 0/1 raster: strips of columns, each an array of rows as integers, the last column in the lowest bit."""
    def strip(first: int) -> Column:
        low, high = max(0, first - HALO), min(w, first + STRIP + HALO)
        # Cells right of the raster are empty.
        empty = first + STRIP + HALO - high
        bits = lambda y: F.aggregate(F.slice(ink, y * w + low + 1, high - low), F.lit(0).cast("bigint"), lambda t, v: t * 2 + v)
        return F.transform(F.sequence(F.lit(0), F.lit(h - 1)), lambda y: F.shiftleft(bits(y), empty))

    return F.array(*[strip(first) for first in range(0, w, STRIP)])


def _near(rows: Column, i: Column, by: int) -> Column:
    return F.coalesce(F.get(rows, i + by), F.lit(0).cast("bigint"))


def _wide(row: Column) -> Column:
    return _or(row, F.shiftleft(row, 1), F.shiftright(row, 1))


def _grown(rows: Column, i: Column) -> Column:
    """Row i of the plane widened by one cell in all directions."""
    return _wide(_or(*[_near(rows, i, d) for d in (-1, 0, 1)]))


def _cleared(rows: Column, row: Column, i: Column) -> Column:
    """Row i without specks: cells outside any full 2x2 block."""
    def block(d: int) -> Column:
        two = _near(rows, i, d).bitwiseAND(_near(rows, i, d + 1))
        full = two.bitwiseAND(F.shiftright(two, 1))
        return _or(full, F.shiftleft(full, 1))

    return _or(block(0), block(-1))


def _linked(rows: Column, row: Column, i: Column) -> Column:
    """Cells of row i with at least two of their eight neighbours."""
    around = [F.shiftleft(row, 1), F.shiftright(row, 1)]
    for d in (-1, 1):
        other = _near(rows, i, d)
        around += [other, F.shiftleft(other, 1), F.shiftright(other, 1)]
    one, two = around[0], F.lit(0).cast("bigint")
    for n in around[1:]:
        one, two = _or(one, n), _or(two, one.bitwiseAND(n))
    return row.bitwiseAND(two)


def tolerant_difference(pairs: DataFrame, a: str, b: str, w: int, h: int, fine: bool = False) -> DataFrame:
    """Share of ink without a counterpart within one cell, specks left out; the worst inked tile counts alone.

    Rasters (0/1, row after row) become bit planes: a row of 50 columns is one integer, with
    its neighbours' columns at both ends; shifts widen it and bit counts add it up.  ``fine``
    keeps groups of three and doubles the share.  Other sizes and nulls differ by 1.
    """
    def planes(name: str, source: str, step) -> dict[str, Column]:
        return {name: F.transform(source, lambda rows: F.transform(rows, lambda row, i: step(rows, row, i)))}

    d = pairs.withColumns({"_a": _strips(F.col(a), w, h), "_b": _strips(F.col(b), w, h)})
    d = d.withColumns(planes("_ga", "_a", lambda rows, row, i: _grown(rows, i)) | planes("_gb", "_b", lambda rows, row, i: _grown(rows, i)))
    alone = lambda x, other: F.zip_with(x, other, lambda p, q: F.zip_with(p, q, lambda u, v: u.bitwiseAND(F.bitwise_not(v))))
    d = d.withColumn("_c", F.zip_with(alone("_a", "_gb"), alone("_b", "_ga"), lambda p, q: F.zip_with(p, q, lambda u, v: u.bitwiseOR(v))))
    if fine:
        d = d.withColumns(planes("_l", "_c", _linked))
        d = d.withColumns(planes("_g", "_l", lambda rows, row, i: _grown(rows, i)))
        d = d.withColumn("_c", F.zip_with("_c", "_g", lambda p, q: F.zip_with(p, q, lambda u, v: u.bitwiseAND(v))))
    else:
        d = d.withColumns(planes("_k", "_c", _cleared)).withColumn("_c", F.col("_k"))
    own = F.lit(((1 << STRIP) - 1) << HALO).cast("bigint")
    count = lambda rows: F.aggregate(rows, F.lit(0).cast("bigint"), lambda t, r: t + F.bit_count(r.bitwiseAND(own)))
    wide = (100 if fine else 150) // STRIP
    tiles = []
    for y in range(0, h, 100):
        for x in range(0, -(-w // STRIP), wide):
            some = lambda c, at=(y, x): sum((count(F.slice(F.get(c, s), at[0] + 1, 100)) for s in range(at[1], min(at[1] + wide, -(-w // STRIP)))), F.lit(0))
            tiles.append(F.struct(some("_c").alias("c"), (some("_a") + some("_b")).alias("ink")))
    d = d.withColumn("_t", F.array(*tiles))
    total = lambda f: F.aggregate("_t", F.lit(0).cast("bigint"), lambda t, s: t + s[f])
    score = F.greatest(total("c") / F.greatest(F.lit(1), total("ink")), F.array_max(F.transform(F.filter("_t", lambda s: s["ink"] >= 100), lambda s: s["c"] / s["ink"])))
    same = (F.size(a) == w * h) & (F.size(b) == w * h)
    score = F.least(F.lit(1.0), score * 2) if fine else score
    return d.select(*pairs.columns, F.when(F.coalesce(same, F.lit(False)), score).otherwise(1.0).alias("diff"))


def local_window_difference(pairs: DataFrame, keys, a: str, b: str, size: int = 128, step: int = 64, min_ink: int = 200) -> DataFrame:
    """Worst unmatched share over overlapping windows of two binary rows, one cell of tolerance."""
    near = lambda other, i: F.greatest(*[F.coalesce(F.get(other, i + d), F.lit(0)) for d in (-1, 0, 1)])
    A, B = F.col(a), F.col(b)
    cells = F.zip_with(A, B, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    cells = F.transform(cells, lambda s, i: F.struct(
        F.when((s["x"] == 1) & (near(B, i) == 0) | (s["y"] == 1) & (near(A, i) == 0), 1).otherwise(0).alias("u"),
        F.greatest(s["x"], s["y"]).alias("k")))
    d = pairs.withColumn("_cells", cells)
    starts = F.sequence(F.lit(0), F.greatest(F.size(A) - 1, F.lit(0)), F.lit(step))
    total = lambda part, f: F.aggregate(part, F.lit(0), lambda t, s: t + s[f])
    scored = F.transform(starts, lambda s: F.struct(total(F.slice("_cells", s + 1, size), "u").alias("u"), total(F.slice("_cells", s + 1, size), "k").alias("k")))
    worst = F.array_max(F.transform(F.filter(scored, lambda s: s["k"] >= min_ink), lambda s: s["u"] / s["k"]))
    return d.withColumn("diff", F.coalesce(worst, F.lit(0.0))).drop("_cells")


def shift_tolerant_difference(pairs: DataFrame, a: str, b: str, max_shift: float = 0.03, good: float = 0.035, anchors: tuple[str, str] | None = None) -> DataFrame:
    """Mismatch of two rows, or of their shared part after the best small shift.

    With ``anchors`` (position arrays) a shift counts only if at least two anchors on each
    side, spanning a quarter of the width, find each other within 2.
    """
    A, B = F.col(a), F.col(b)
    n = F.size(A)

    def rate(s):
        lo, hi = F.greatest(F.lit(0), -s), F.greatest(F.lit(0), s)
        length = n - F.abs(s)
        bad = F.zip_with(F.slice(A, lo + 1, length), F.slice(B, hi + 1, length), lambda x, y: F.when(x.eqNullSafe(y), 0).otherwise(1))
        return F.aggregate(bad, F.lit(0), lambda t, v: t + v) / length

    reach = F.floor(n * max_shift).cast("int")
    direct = F.when(n != F.size(B), F.lit(1.0)).otherwise(rate(F.lit(0)))
    d = pairs.withColumn("_direct", direct)
    shifts = F.filter(F.sequence(-reach, reach), lambda s: s != 0)
    if anchors is not None:
        p, q = F.col(anchors[0]), F.col(anchors[1])

        def follows(s):
            x = F.filter(p, lambda v: (v > 4) & (v < n - 4) & (v + s > 4) & (v + s < n - 4))
            y = F.filter(q, lambda v: (v > 4) & (v < n - 4) & (v - s > 4) & (v - s < n - 4))
            span = (F.array_max(x) - F.array_min(x) >= n * 0.25) & (F.array_max(y) - F.array_min(y) >= n * 0.25)
            both = F.forall(x, lambda v: F.exists(y, lambda u: F.abs(v + s - u) <= 2)) & F.forall(y, lambda u: F.exists(x, lambda v: F.abs(v + s - u) <= 2))
            return F.coalesce((F.size(x) >= 2) & (F.size(y) >= 2) & span & both, F.lit(False))

        shifts = F.filter(shifts, follows)
    tried = F.array_min(F.transform(shifts, lambda s: F.struct(rate(s).alias("e"), F.abs(s).alias("m"), s.alias("s"))))
    d = d.withColumn("_best", F.when((F.col("_direct") > good) & (n == F.size(B)), tried))
    better = F.coalesce(F.col("_best")["e"] < F.col("_direct"), F.lit(False))
    return d.withColumns({"diff": F.when(better, F.col("_best")["e"]).otherwise(F.col("_direct")),
                          "shift": F.when(better, F.col("_best")["s"]).otherwise(0)}).drop("_direct", "_best")


def masked_columns(tint: Column, w: int, h: int, share: float = 0.6, grow: int = 4) -> Column:
    """Columns under a cursor-like band: mostly tinted, and no more than 8% of the width.

    ``tint`` is a 0/1 raster; the result is a 0/1 array over columns, widened by ``grow``.
    """
    cols = F.transform(F.sequence(F.lit(0), F.lit(w - 1)), lambda x: F.when(
        F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(h - 1)), lambda y: F.get(tint, y * w + x)), F.lit(0), lambda t, v: t + v) / h > share, 1).otherwise(0))
    n = F.aggregate(cols, F.lit(0), lambda t, v: t + v)
    wide = F.transform(cols, lambda _, i: F.array_max(F.slice(cols, F.greatest(i - grow + 1, F.lit(1)), F.least(i + grow, F.lit(w - 1)) - F.greatest(i - grow, F.lit(0)) + 1)))
    return F.when((n > 0) & (n <= w * 0.08), wide)


def clear_masked(ink: Column, mask_a: Column, mask_b: Column, w: int) -> Column:
    """Ink with the columns masked on either side removed."""
    return F.transform(ink, lambda v, i: F.when((F.coalesce(F.get(mask_a, i % w), F.lit(0)) == 1) | (F.coalesce(F.get(mask_b, i % w), F.lit(0)) == 1), 0).otherwise(v))


def numbered_identity(a: Column, b: Column, diff: Column) -> Column:
    """Different known numbers are always different; an unknown number is no evidence."""
    return F.when(a.isNotNull() & b.isNotNull() & (a != b), F.lit(1.0)).otherwise(diff)


def _mean_difference(a, b) -> Column:
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, v: s + v)
    return total / F.size(a)


def prototype_candidates(df: DataFrame, row: list[str], vec: str, prototypes: DataFrame, label: str, proto: str, margin: float, cell: float) -> DataFrame:
    """``row, err, label`` for the templates that can be a row's nearest, or within ``margin`` of it.

    Some templates are pivots.  A row's nearest pivot bounds its error; by the triangle
    inequality a template whose distance from a pivot differs from the row's by more than
    that bound and ``margin`` is no candidate.  Rows and templates meet on the row's nearest
    pivot and the cell of the template's distance from it, the other pivots sift the pairs,
    and only what is left is compared.
    """
    t = runtime.checkpoint(prototypes.select(F.col(label).alias("_label"), F.col(proto).cast("array<double>").alias("_t")).filter(F.col("_t").isNotNull()).distinct())
    chosen = t.orderBy(F.xxhash64("_t"), "_t", "_label").limit(PIVOTS).agg(F.collect_list("_t"))
    far = lambda v: F.transform("_pivots", lambda p: _mean_difference(F.col(v), p))
    t = t.withColumn("_pivots", chosen.scalar()).withColumn("_td", far("_t")).drop("_pivots")
    t = t.select("_label", "_t", "_td", F.posexplode("_td").alias("_p", "_at")).filter(F.col("_at").isNotNull())
    t = t.withColumn("_cell", F.floor(F.col("_at") / cell)).drop("_at")
    r = df.select(*row, F.col(vec).cast("array<double>").alias("_v")).withColumn("_pivots", chosen.scalar()).withColumn("_rd", far("_v")).drop("_pivots")
    r = r.withColumn("_u", F.array_min("_rd")).withColumn("_reach", F.col("_u") + margin + 1e-9)
    r = r.withColumn("_p", (F.array_position("_rd", F.col("_u")) - 1).cast("int"))
    r = r.withColumn("_cell", F.explode_outer(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_u") + F.col("_reach")) / cell).cast("bigint"))))
    near = F.forall(F.zip_with("_rd", "_td", lambda x, y: F.abs(x - y)), lambda x: x <= F.col("_reach"))
    return r.join(runtime.small(t), ["_p", "_cell"]).filter(near).select(*row, _mean_difference(F.col("_v"), F.col("_t")).alias("err"), F.col("_label").alias(label))


def nearest_prototype(df: DataFrame, row: list[str], vec: str, prototypes: DataFrame, label: str, proto: str, max_err: float = 0.29, margin: float = 0.025, cell: float = 0.02) -> DataFrame:
    """Label of the class with the nearest template, null if far or not clearly best.

    Exact, though only candidates are compared (``prototype_candidates``).  Rows without a
    vector, or of another length than the templates, have neither label nor error.
    """
    found = prototype_candidates(df, row, vec, prototypes, label, proto, margin, cell)
    # The best of each class, then the best class and whether another comes within the margin.
    per = found.groupBy(*row, label).agg(F.min("err").alias("_e"))
    g = per.groupBy(*row).agg(F.min(F.struct("_e", label)).alias("_one"), F.slice(F.array_sort(F.collect_list("_e")), 1, 2).alias("_two"))
    second = F.get("_two", F.lit(1))
    sure = (F.col("_one._e") <= max_err) & (second.isNull() | (second - F.col("_one._e") >= margin))
    g = g.select(*row, F.when(sure, F.col("_one")[label]).alias(label), F.col("_one._e").alias("err"))
    every = df.select(*row).distinct()
    return every.join(g, row, "left").select(*row, label, "err")



def digit_groups(df: DataFrame, keys, x: str, x2: str, y: str, digit: str, spacing: float, tie: list[str], center: float | None = None) -> DataFrame:
    """Numbers 1..999 read from neighbouring digits."""
    o = Ordered(df, keys, [x, *tie]).with_columns(_p=lag(F.struct(F.col(x2).alias("x2"), F.col(y).alias("y"))))
    p = F.col("_p")
    same = F.coalesce((F.col(x) - p["x2"] < spacing * 0.45) & (F.abs(F.col(y) - p["y"]) < spacing * 0.2), F.lit(False))
    o = o.columns(_new=F.when(same, 0).otherwise(1)).with_columns(_g=running_sum("_new"))
    size = Ordered(o.df, [*keys, "_g"], [x, *tie], chunked=o.fewer)
    d = size.with_columns(_rn=row_number()).result
    # A group of more than three digits is no number; only the first four matter to know that.
    g = d.groupBy(*keys, "_g").agg(F.count(F.lit(1)).alias("_n"), F.min(x).alias("left"), F.max(x2).alias("right"),
                                   F.array_sort(F.collect_list(F.when(F.col("_rn") <= 3, F.struct(F.col("_rn").alias("r"), F.col(digit).cast("string").alias("d"))))).alias("_d"))
    number = F.array_join(F.transform("_d", lambda s: s["d"]), "").cast("int")
    out = g.filter("_n <= 3").withColumn("number", number).filter(F.col("number").between(1, 999))
    if center is not None:
        out = out.filter(F.abs((F.col("left") + F.col("right")) / 2 - center) < spacing * 0.2)
    return out.select(*keys, "left", "right", "number")
