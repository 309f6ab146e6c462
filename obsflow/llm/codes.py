"""Compression of vectors to codes of one byte a part, with codebooks from dual-tree Lloyd rounds.

Components become integers, vectors are cut into equal parts, and every part position has
its own codebook.  Rows are taken in blocks.  In a block each part position has a tree over
its parts (halved along the widest side) and one over its codebook entries; both are walked
together.  A pair of nodes is dropped when every part of one node is nearer to some other
entry, by the boxes' least and greatest distances, and single entries also when the box lies
on the other side of the plane between two entries.  A node of parts left with one entry is
assigned whole, with its cached sums; parts in leaves that stay uncertain are compared as
integers.  All bounds are integers, so the codes are those of a full comparison.
"""

from __future__ import annotations

import hashlib
import math
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsflow.plans import runtime

SCALE = 256
PARTS = 16
ENTRIES = 64
ROUNDS = 2
# Rows of a block (at least, where a task has as many), and parts in a leaf of its trees.
BLOCK = 16384
LEAF = 8


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all runs [start, start + size), one run after the other."""
    end = np.cumsum(size)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(start - end + size, size)


def _heads(group: np.ndarray) -> np.ndarray:
    """Where a new number starts in a sorted array."""
    return np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))[:len(group)])


class _Forest:
    """One tree for each of ``trees`` equally long runs of points (one row for each component).

    ``bounds`` holds the nodes of each level as positions in ``order``; ``low``, ``high`` and
    ``total`` their boxes and sums.
    """

    def __init__(self, points: np.ndarray, trees: int, leaf: int):
        n = points.shape[1] // trees
        self.order, x = np.arange(points.shape[1]), points
        self.bounds = [np.arange(trees + 1) * n]
        while n > leaf:
            at = self.bounds[-1]
            side = np.argmax(np.maximum.reduceat(x, at[:-1], axis=1) - np.minimum.reduceat(x, at[:-1], axis=1), axis=0)
            node = np.repeat(np.arange(len(at) - 1), np.diff(at))
            by = np.lexsort((x[side[node], np.arange(len(node))], node))
            self.order, x = self.order[by], x[:, by]
            self.bounds.append(np.append(np.stack([at[:-1], (at[:-1] + at[1:]) // 2], axis=1), at[-1]))
            n = np.diff(self.bounds[-1]).max()
        at = self.bounds[-1]
        low, high, total = np.minimum.reduceat(x, at[:-1], axis=1), np.maximum.reduceat(x, at[:-1], axis=1), np.add.reduceat(x, at[:-1], axis=1)
        # A node that was halved to nothing has the box of its neighbour's first point, and no sum.
        total[:, np.diff(at) == 0] = 0
        self.levels = [(low, high, total)]
        for _ in self.bounds[1:]:
            low, high, total = np.minimum(low[:, ::2], low[:, 1::2]), np.maximum(high[:, ::2], high[:, 1::2]), total[:, ::2] + total[:, 1::2]
            self.levels.insert(0, (low, high, total))


def _squares(rows) -> np.ndarray:
    """Sum of the squares of several rows."""
    return sum(r * r for r in rows)


class Assigned:
    """Where a block's parts go: nodes assigned whole, and single parts of uncertain leaves.

    ``points`` and ``entries`` have a row for each component and hold the columns of part
    after part, each with equally many; an entry's id is its column.
    """

    def __init__(self, points: np.ndarray, entries: np.ndarray, parts: int, leaf: int = LEAF):
        self.points, self.entries = points, entries
        self.tree = tree = _Forest(points, parts, leaf)
        books = _Forest(entries, parts, 1)
        self.whole: list[tuple[int, np.ndarray, np.ndarray]] = []
        # Pairs of nodes, and of parts and entries, that were looked at.
        self.compared = 0
        last_p, last_e = len(tree.bounds) - 1, len(books.bounds) - 1
        p = e = np.arange(parts)
        for step in range(max(last_p, last_e) + 1):
            level_p, level_e = min(step, last_p), min(step, last_e)
            if step and step <= last_e:
                p, e = np.repeat(p, 2), np.stack([2 * e, 2 * e + 1], axis=1).ravel()
                full = np.diff(books.bounds[level_e])[e] > 0
                p, e = p[full], e[full]
            if step and step <= last_p:
                head = _heads(p)
                size = np.diff(np.append(head, len(p)))
                node = p[head]
                e = e[_spans(np.repeat(head, 2), np.repeat(size, 2))]
                p = np.repeat(np.stack([2 * node, 2 * node + 1], axis=1).ravel(), np.repeat(size, 2))
            if not len(p):
                break
            p, e = self._near(p, e, tree.levels[level_p], books.levels[level_e])
            if level_e == last_e:
                p, e = self._one_side(p, e, books.order[books.bounds[-1][e]], tree.levels[level_p])
                one = np.bincount(p, minlength=0)[p] == 1
                self.whole.append((level_p, p[one], books.order[books.bounds[-1][e[one]]]))
                p, e = p[~one], e[~one]
        entry = books.order[books.bounds[-1][e]] if len(e) else e
        by = np.lexsort((entry, p))
        self._compare(p[by], entry[by])

    def _near(self, p, e, nodes, books):
        """Pairs whose least distance is not above some greatest distance of the node."""
        low, high, _ = nodes
        near, far, _ = books
        gap = reach = 0
        for lo, hi, a, b in zip(low, high, near, far, strict=True):
            above, below = a[e] - hi[p], lo[p] - b[e]
            short, long = np.maximum(0, np.maximum(above, below)), np.maximum(hi[p] - a[e], b[e] - lo[p])
            gap, reach = gap + short * short, reach + long * long
        self.compared += len(p)
        head = _heads(p)
        keep = gap <= np.repeat(np.minimum.reduceat(reach, head), np.diff(np.append(head, len(p))))
        return p[keep], e[keep]

    def _one_side(self, p, e, entry, nodes):
        """Pairs whose entry some place of the node's box has as nearest, against the entry nearest to the box's middle."""
        low, high, _ = nodes
        head = _heads(p)
        size = np.diff(np.append(head, len(p)))
        c = [row[entry] for row in self.entries]
        middle = _squares(2 * x - lo[p] - hi[p] for x, lo, hi in zip(c, low, high, strict=True))
        best = np.flatnonzero(middle == np.repeat(np.minimum.reduceat(middle, head), size))
        rival = np.repeat(entry[best[_heads(p[best])]], size)
        a = b = 0
        for x, row, lo, hi in zip(c, self.entries, low, high, strict=True):
            r = row[rival]
            corner = np.where(x > r, hi[p], lo[p])
            a, b = a + (corner - x) ** 2, b + (corner - r) ** 2
        keep = (a < b) | (a == b) & (entry <= rival)
        return p[keep], e[keep]

    def _compare(self, p, entry) -> None:
        """Nearest entry of every part in the leaves of ``p``, by the leaf's entries in ascending order."""
        at = self.tree.bounds[-1]
        head = _heads(p)
        leaf, size = p[head], np.diff(np.append(head, len(p)))
        parts = np.diff(at)[leaf]
        rows = self.tree.order[_spans(at[:-1][leaf], parts)]
        size = np.repeat(size, parts)
        pair = _spans(np.repeat(head, parts), size)
        self.compared += len(pair)
        self.rows, self.row_entry = rows, rows
        if len(rows):
            distance = _squares(np.repeat(x[rows], size) - c[entry][pair] for x, c in zip(self.points, self.entries, strict=True))
            group = np.repeat(np.arange(len(rows)), size)
            best = np.flatnonzero(distance == np.repeat(np.minimum.reduceat(distance, np.cumsum(size) - size), size))
            self.row_entry = entry[pair[best[_heads(group[best])]]]

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        """How many parts each entry has, and their sum."""
        count = np.zeros(self.entries.shape[1], dtype=np.int64)
        total = np.zeros_like(self.entries)
        for level, node, entry in self.whole:
            np.add.at(count, entry, np.diff(self.tree.bounds[level])[node])
            for t, s in zip(total, self.tree.levels[level][2], strict=True):
                np.add.at(t, entry, s[node])
        np.add.at(count, self.row_entry, 1)
        for t, x in zip(total, self.points, strict=True):
            np.add.at(t, self.row_entry, x[self.rows])
        return count, total

    def codes(self) -> np.ndarray:
        out = np.empty(self.points.shape[1], dtype=np.int64)
        for level, node, entry in self.whole:
            at = self.tree.bounds[level]
            size = np.diff(at)[node]
            out[self.tree.order[_spans(at[:-1][node], size)]] = np.repeat(entry, size)
        out[self.rows] = self.row_entry
        return out


def scaled(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) as integers: 64 bits where sums of squared differences fit them, else Python's."""
    x = np.asarray(values, dtype=np.float64)
    if x.size == 0 or np.abs(x).max() * scale < 1 << 24:
        return np.floor(x * scale).astype(np.int64)
    return np.array([math.floor(v) * scale + math.floor((v - math.floor(v)) * scale) for v in x.tolist()], dtype=object)


def _blocks(batches, dim: int, parts: int):
    """Blocks of rows as integers: (record batches of the rows, a row for each component, columns of part after part)."""
    def block(held):
        flat = np.concatenate([b.column(b.num_columns - 1).flatten().to_numpy(zero_copy_only=False) for b in held])
        return held, np.ascontiguousarray(scaled(flat).reshape(-1, parts, dim // parts).transpose(2, 1, 0)).reshape(dim // parts, -1)

    held, count = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            held.append(batch.slice(at, BLOCK))
            count += held[-1].num_rows
            if count >= BLOCK:
                yield block(held)
                held, count = [], 0
    if held:
        yield block(held)


def _widened(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (points.astype(object), entries.astype(object)) if object in (points.dtype, entries.dtype) else (points, entries)


def kept_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``vec_id, label, vector`` of rows whose vector is there and has finite components only."""
    v = F.col(vector_col).cast("array<double>")
    fine = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.filter(F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).alias("label"), v.alias("vector"))


def _numbers(rows) -> np.ndarray:
    """64-bit integers with room for sums of squares, else Python's."""
    wide = max((abs(x) for r in rows for x in r), default=0) >= 1 << 24
    return np.array(rows, dtype=object if wide else np.int64)


def trained(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[int, np.ndarray]:
    """Dimension and codebooks (a row for each component, a column for each entry of part after part) from ``vec_id, label, vector``.

    Each round is one pass over all rows; a task keeps only the counts and sums of the
    entries.  The driver holds ``entries`` vectors.
    """
    first = kept.select("vec_id", "vector").orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()
    if not first or not first[0].vector:
        return 0, np.empty((0, 0), dtype=np.int64)
    dim = len(first[0].vector)
    if dim % parts:
        raise ValueError(f"vectors of {dim} components cannot be cut into {parts} equal parts")
    first = kept.filter(F.size("vector") == dim).select("vec_id", "vector").orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect() if any(len(r.vector) != dim for r in first) else first
    width, rows = dim // parts, kept.filter(F.size("vector") == dim).select("vector")
    start = [[int(x) for x in scaled(r.vector)] for r in first]
    books = _numbers([[r[p * width + i] for p in range(parts) for r in start] for i in range(width)])
    schema = T.StructType([T.StructField("slot", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("sums", T.ArrayType(T.DecimalType(38, 0)))])
    arrow = pa.schema([("slot", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0)))])
    for _ in range(rounds):
        def counted(batches, books=books):
            count, total = np.zeros(books.shape[1], dtype=np.int64), np.zeros(books.shape, dtype=object)
            for _, points in _blocks(batches, dim, parts):
                n, s = Assigned(*_widened(points, books), parts).sums()
                count += n
                total += s.astype(object)
            slots = np.flatnonzero(count)
            if len(slots):
                yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), pa.array(count[slots]), pa.array([[Decimal(int(x)) for x in total[:, s]] for s in slots], arrow.field("sums").type)], schema=arrow)

        new = rows.mapInArrow(counted, schema).groupBy("slot").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)]).collect()
        moved = {r.slot: [int(r[f"s{i}"]) // r.n for i in range(width)] for r in new}
        books = _numbers([[moved[e][i] if e in moved else int(x) for e, x in enumerate(row)] for i, row in enumerate(books)])
    return dim, books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in books.T.ravel()).encode()).hexdigest()


def encoded(kept: DataFrame, dim: int, books: np.ndarray, parts: int = PARTS) -> DataFrame:
    """``vec_id, label, code, error`` of the rows whose vectors have ``dim`` components.

    ``error`` is null where it does not fit 64 bits.
    """
    m = books.shape[1] // parts
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", kept.schema["label"].dataType), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def run(batches):
        names = np.array([f"{i:02x}" for i in range(max(m, 1))])
        for held, points in _blocks(batches, dim, parts):
            x, b = _widened(points, books)
            entry = Assigned(x, b, parts).codes()
            error = _squares(r - c[entry] for r, c in zip(x, b, strict=True)).reshape(parts, -1).sum(axis=0)
            code = names[np.ascontiguousarray((entry % m).reshape(parts, -1).T)].view(f"<U{names.itemsize // 4 * parts}").ravel()
            done = 0
            for part in held:
                to = done + part.num_rows
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(code[done:to].tolist(), pa.string()), pa.array([v if v < 1 << 63 else None for v in map(int, error[done:to])], pa.int64())],
                                                 names=["vec_id", "label", "code", "error"])
                done = to

    return kept.filter(F.size("vector") == dim).select("vec_id", "label", "vector").mapInArrow(run, schema)


def compressed(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``vec_id, label, code, error, label_error, codebooks_sha256`` of every kept row.

    Dropped are rows whose vector is null or has null or non-finite components, and rows
    with another number of components than the kept row of the smallest id; that number has
    to be a multiple of ``parts``, else a ValueError.  Fewer rows than ``entries`` give
    smaller codebooks; no rows or empty vectors give no rows.  Rows with equal ids are
    encoded each for itself; null ids come last among the starting entries.  Null labels
    are one label; a sum of theirs that does not fit 64 bits is null.  Other columns are ignored.
    """
    kept = kept_vectors(vectors, id_col, vector_col, label_col)
    dim, books = trained(kept, parts, entries, rounds)
    if not dim:
        return kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"), F.lit(0).cast("bigint").alias("label_error"), F.lit("").alias("codebooks_sha256")).limit(0)
    rows = runtime.checkpoint(encoded(kept, dim, books, parts))
    per = rows.groupBy(F.col("label").alias("_label")).agg(F.expr("try_cast(sum(cast(error as decimal(38,0))) as bigint)").alias("label_error"))
    return (rows.join(runtime.small(per), F.col("label").eqNullSafe(F.col("_label")), "left")
            .select("vec_id", "label", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")))
