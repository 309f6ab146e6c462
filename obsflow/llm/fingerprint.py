"""Fingerprints from prefix polynomial hashes.

P[i] = sum of c_j * B**j over j < i, modulo the prime 2**31 - 1, for two bases.  The hash
of a span moved to position 0 is (P[end] - P[start]) * B**-start, so any two spans, also of
different texts, are compared in constant time, and the longest common extension of two
positions is found by binary search over span lengths.

The fingerprint of a text is its length, the hash of the whole and the ``SIZE`` smallest
distinct hashes of its spans of ``WIDTH`` code points (bottom-k).  Likeness of two
fingerprints is the share of common hashes among the smallest of both, an estimate of the
Jaccard index of their spans.  A text put together from two spans needs only the span
hashes of the parts and of the seam.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsflow.llm.texts import map_rows, mixed, worker_state

PRIME = np.uint64((1 << 31) - 1)
BASES = (1_000_003_123 % int(PRIME), 1_482_938_473 % int(PRIME))
WIDTH = 24
SIZE = 64


def _reduce(x: np.ndarray) -> np.ndarray:
    """x modulo 2**31 - 1 for x below 2**63."""
    x = (x & PRIME) + (x >> np.uint64(31))
    x = (x & PRIME) + (x >> np.uint64(31))
    return np.where(x >= PRIME, x - PRIME, x)


def _powers(n: int) -> tuple[tuple[np.ndarray, np.ndarray], ...]:
    """Powers of each base and of its inverse, kept by the worker and doubled when too few."""
    state = worker_state("powers")
    have = state.get("powers")
    if have is None or len(have[0][0]) < n:
        size = max(1 << 12, 1 << (n - 1).bit_length())
        have = state["powers"] = tuple(tuple(_geometric(b, size) for b in (base, pow(base, -1, int(PRIME)))) for base in BASES)
    return have


def _geometric(base: int, n: int) -> np.ndarray:
    out = np.ones(1, dtype=np.uint64)
    while len(out) < n:
        out = np.concatenate([out, _reduce(out * np.uint64(pow(base, len(out), int(PRIME))))])
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class PrefixHashes:
    """Prefix arrays of one text."""

    def __init__(self, text: str | np.ndarray):
        self.points = code_points(text) if isinstance(text, str) else text
        n = len(self.points)
        self.powers = _powers(n + 1)
        c = self.points.astype(np.uint64) + np.uint64(1)
        self.sums = []
        for up, _ in self.powers:
            p = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(_reduce(c * up[:n]), out=p[1:])
            self.sums.append(_reduce(p))

    def __len__(self) -> int:
        return len(self.points)

    def span(self, start: int, length: int) -> int:
        """Hash of a span, the same wherever the span stands."""
        out = 0
        for p, (_, down) in zip(self.sums, self.powers, strict=True):
            h = (int(p[start + length]) - int(p[start])) * int(down[start]) % int(PRIME)
            out = out << 31 | h
        return out

    def spans(self, width: int) -> np.ndarray:
        """Hashes of all spans of one width."""
        n = len(self) - width + 1
        if n <= 0:
            return np.empty(0, dtype=np.uint64)
        out = np.zeros(n, dtype=np.uint64)
        for p, (_, down) in zip(self.sums, self.powers, strict=True):
            out = out << np.uint64(31) | _reduce(_reduce(p[width:] + PRIME - p[:n]) * down[:n])
        return out

    def equal(self, start: int, other: PrefixHashes, at: int, length: int) -> bool:
        return self.span(start, length) == other.span(at, length)

    def extension(self, start: int, other: PrefixHashes, at: int) -> int:
        """Length of the longest common extension of the two positions."""
        low, high = 0, min(len(self) - start, len(other) - at)
        while low < high:
            mid = (low + high + 1) // 2
            if self.equal(start, other, at, mid):
                low = mid
            else:
                high = mid - 1
        return low


def _smallest(h: np.ndarray, size: int) -> np.ndarray:
    """The smallest distinct values."""
    take = 4 * size
    while take < len(h):
        got = np.unique(np.partition(h, take)[:take])
        if len(got) >= size:
            return got[:size]
        take *= 4
    return np.unique(h)[:size]


def _sketch(spans: np.ndarray, whole: int) -> np.ndarray:
    """Short texts, without a span, are represented by their whole hash."""
    h = mixed(spans if len(spans) else np.array([whole], dtype=np.uint64))
    return _smallest(h >> np.uint64(32), SIZE)


def fingerprint(length: int, whole: int, sketch: np.ndarray) -> str:
    return f"{length:x}.{whole:016x}." + sketch.astype(">u4").tobytes().hex()


def likeness(x: str, y: str) -> float:
    """Share of common hashes among the smallest of both; equal fingerprints 1, an empty text and another 0."""
    if x == y:
        return 1.0
    a, b = (np.frombuffer(bytes.fromhex(s.rsplit(".", 1)[1]), dtype=">u4") for s in (x, y))
    if x.startswith("0.") or y.startswith("0."):
        return 0.0
    # As many of the union's smallest as both sketches are sure to hold.
    union = np.union1d(a, b)[:max(min(len(a), len(b)), SIZE) if max(len(a), len(b)) >= SIZE else None]
    return float(np.isin(union, np.intersect1d(a, b), assume_unique=True).mean())


class _Print:
    """Span hashes of one document, from which edited texts are fingerprinted."""

    def __init__(self, text: str):
        self.text = text
        self.hashes = PrefixHashes(text)
        self.spans = self.hashes.spans(WIDTH)
        self.whole = self.hashes.span(0, len(text))
        self.value = fingerprint(len(text), self.whole, _sketch(self.spans, self.whole))

    def edited(self, other: _Print) -> tuple[str, str, int]:
        """The text with its last half replaced by the start of the other one, its fingerprint, and the common prefix."""
        n = len(self.text)
        keep = n - n // 2
        text = self.text[:keep] + other.text[:n // 2]
        left, right = max(0, keep - WIDTH + 1), max(0, min(n // 2, len(other.text)) - WIDTH + 1)
        seam = PrefixHashes(text[left:keep + WIDTH - 1]).spans(WIDTH)
        whole = 0
        for p, q, (up, _) in zip(self.hashes.sums, other.hashes.sums, self.hashes.powers, strict=True):
            whole = whole << 31 | (int(p[keep]) + int(q[len(text) - keep]) * int(up[keep])) % int(PRIME)
        spans = np.concatenate([self.spans[:left], seam, other.spans[:right]])
        common = keep
        if keep < n:
            common += self.hashes.extension(keep, other.hashes, 0) if len(text) > keep else 0
        return text, fingerprint(len(text), whole, _sketch(spans, whole)), min(common, len(text), n)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows dealt so that each partition holds stretches of descending ids: ``part, doc_id, text, only_next``.

    Ids are cut at quantiles into four stretches a partition.  The row after a stretch is
    the first of the next one (after the last stretch, the very first); these, one for
    each stretch, are sent to both.
    """
    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    spark = d.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = d.agg(F.percentile_approx("doc_id", [i / (4 * parts) for i in range(1, 4 * parts)], 10_000)).first()[0]
    # Null ids come last, as in a descending sort; stretch 0 holds the largest ids.
    edges = sorted(set(cuts or []), reverse=True)
    # The number of cuts above the id, looked up in two steps.
    step = max(1, int(len(edges) ** 0.5))
    chunks = [edges[i:i + step] for i in range(0, len(edges), step)] or [[-(1 << 63)]]
    above = lambda cuts: F.size(F.filter(cuts, lambda e: e > F.col("doc_id")))
    whole = above(F.lit([c[-1] for c in chunks]).cast("array<bigint>"))
    inside = above(F.coalesce(F.get(F.lit(chunks).cast("array<array<bigint>>"), whole), F.array().cast("array<bigint>")))
    stretch = F.when(F.col("doc_id").isNull(), F.lit(len(edges) + 1)).otherwise(whole * step + inside)
    cut = d.withColumn("part", stretch.cast("int"))
    # One row a stretch: its first row by (id, text) descending.
    tops = {r["part"]: (r["doc_id"], r["sha"]) for r in cut.groupBy("part").agg(F.max(F.struct("doc_id", F.sha2("text", 256).alias("sha"))).alias("m")).select("part", "m.*").collect()}
    order = sorted(tops)
    before = {p: order[i - 1] for i, p in enumerate(order)}
    also = [(p, *tops[p], before[p]) for p in order]
    heads = spark.createDataFrame(also, "part int, doc_id bigint, sha string, to int")
    hit = (F.col("h.part") == F.col("c.part")) & F.col("h.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("h.sha") == F.sha2("c.text", 256))
    return (cut.alias("c").join(F.broadcast(heads.alias("h")), hit, "left")
            .select(F.explode(F.when(F.col("h.to").isNull(), F.array(F.struct(F.col("c.part").alias("part"), F.lit(False).alias("only_next"))))
                              .otherwise(F.array(F.struct(F.col("c.part").alias("part"), F.lit(False).alias("only_next")), F.struct(F.col("h.to").alias("part"), F.lit(True).alias("only_next"))))).alias("g"),
                    "c.doc_id", "c.text")
            .select("g.part", "doc_id", "text", "g.only_next").repartition(parts, "part"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, common_prefix`` of every row.

    The edited text has the last half of a text replaced by the start of the next row's in
    descending id order (equal ids by the texts' SHA-256 descending, null ids last; after
    the last row the first).  A null text is empty; a single row follows itself.
    ``common_prefix`` is the longest common extension of text and edited text from their
    starts.  Other columns are ignored.
    """
    def run(batches):
        import pyarrow as pa
        out, held, key = [], None, None

        def row(cur, nxt):
            doc, p = cur
            text, value, common = p.edited(nxt)
            return doc, len(p.text), hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(), p.value, value, likeness(p.value, value), likeness(p.value, nxt.value), common

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], schema=_SCHEMA)

        for b in batches:
            for at in range(0, b.num_rows, 64):
                for part, doc, text, only in zip(*(c.to_pylist() for c in b.slice(at, 64).columns), strict=True):
                    now = _Print(text)
                    if key == part and held is not None:
                        out.append(row(held, now))
                    held, key = (None if only else (doc, now)), part
                if len(out) >= 256:
                    yield batch(out)
                    out = []
        if out:
            yield batch(out)

    dealt = with_next(docs, id_col, text_col).withColumn("sha", F.sha2("text", 256)).sortWithinPartitions("part", "only_next", F.desc_nulls_last("doc_id"), F.desc("sha"))
    return dealt.select("part", "doc_id", "text", "only_next").mapInArrow(run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix bigint")


def _schema():
    import pyarrow as pa
    return pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
                      ("near_edited", pa.float64()), ("near_next", pa.float64()), ("common_prefix", pa.int64())])


_SCHEMA = _schema()
