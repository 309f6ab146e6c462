"""Frequent phrases of each language and how strongly their words belong together.

Texts are dealt in compressed chunks into blocks, once.  In a block, numpy prefix polynomials hash all words and then
all runs of n words: a fingerprint of 64 bits and a check of 32.  Level by level, from one
word to the longest phrases, the distinct fingerprints of the blocks meet in buckets, which
add up their counts and tell each block which of its phrases are frequent; the next level
hashes only phrases whose two shorter parts both are.  Neither a block nor a bucket depends on how often a
phrase occurs: a block sends each phrase once.

Only frequent phrases become text.  The first and the last block that hold a fingerprint
both spell out its first and last place in them; where these texts differ, all phrases of that fingerprint are counted
again by their text.  Phrases that agree in all 96 bits and are not told apart by these
texts would be counted as one; among n distinct ones that is expected n * n / 2**97 times.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsflow.llm.texts import worker_state
from obsflow.plans import runtime

MIN_COUNT = 30
LONGEST = 4
TOP = 2000
# Percentage of its occurrences inside a longer phrase from which a phrase is dropped.
INSIDE = 80
# Text bytes of a block; there are as many buckets as blocks.
BLOCK = 4 << 20
# Bytes hashed at a time.
STRETCH = 1 << 20
_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[list(b" \t")] = 1
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# Text bytes of a chunk (or one document) and its most documents.
CHUNK, CHUNK_ROWS = 512 << 10, 512
_CHUNKS = "docs binary"
_BLOBS = "level int, bucket int, block bigint, fps binary, checks binary, counts binary"
_MARKS = "level int, block bigint, fps binary, own binary, own_checks binary, own_counts binary"
_FOUND = "level int, fp bigint, check long, lang string, phrase string, a bigint"


def _values(seed: int) -> np.ndarray:
    """A number for every byte value, from a rule."""
    return np.array([xxhash.xxh3_64_intdigest(bytes([b]), seed) for b in range(256)], dtype=np.uint64)


_BYTE, _BYTE_CHECK = _values(1), _values(2)


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n."""
    kept = worker_state("phrases")
    have = kept.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, STRETCH)
        have = kept[base] = tuple(np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(size, b, dtype=np.uint64))]) for b in (np.uint64(base), np.uint64(pow(base, -1, 1 << 64))))
        if size > 4 * STRETCH:
            del kept[base]
    return have


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _MIX
    return h ^ (h >> np.uint64(29))


def _spans(values: np.ndarray, base: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hash of values[start:end] for many spans, from one prefix array."""
    power, inverse = _powers(base, len(values) + 1)
    prefix = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(values * power[:len(values)], dtype=np.uint64)])
    return (prefix[end] - prefix[start]) * inverse[start]


def _chunks(batches):
    """Rows ``text, lang`` as compressed chunks of some rows each."""
    def packed(rows: pa.RecordBatch):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(rows)
        return pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["docs"])

    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(0)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            to = min(at + CHUNK_ROWS, max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + CHUNK, side="right"))))
            yield packed(batch.slice(at, to - at))
            at = to


def _words(chunks: pa.Table) -> Words:
    docs = [pa.ipc.open_stream(c.as_py()).read_all() for c in chunks.column("docs")]
    both = pa.concat_tables(docs) if docs else pa.table({"text": pa.array([], pa.string()), "lang": pa.array([], pa.string())})
    return Words(both.column(0), both.column(1))


class Words:
    """The words of some texts: where they are, which piece of a text they are in, their hashes."""

    def __init__(self, texts: pa.ChunkedArray, langs: pa.ChunkedArray):
        t = texts.cast(pa.large_binary()).combine_chunks().fill_null(b"")
        if isinstance(t, pa.ChunkedArray):
            t = pa.concat_arrays(t.chunks) if t.num_chunks else pa.array([], pa.large_binary())
        at = np.frombuffer(t.buffers()[1], dtype=np.int64)[t.offset:t.offset + len(t) + 1] if len(t) else np.zeros(1, dtype=np.int64)
        data = np.frombuffer(t.buffers()[2] or b"", dtype=np.uint8)[at[0]:at[-1]]
        at = at - at[0]
        kind = _KIND[data]
        inside = kind == 0
        heads = np.zeros(len(data) + 1, dtype=bool)
        heads[at] = True
        joined = np.concatenate([[False], inside[:-1] & inside[1:], [False]])[:len(data) + 1] if len(data) else np.zeros(1, dtype=bool)
        joined &= ~heads
        self.start = np.flatnonzero(inside & ~joined[:len(data)])
        self.end = np.flatnonzero(inside & ~joined[1:]) + 1
        self.text = _LOWER[data]
        doc = np.searchsorted(at, self.start, side="right") - 1
        self.piece = (np.searchsorted(np.flatnonzero(kind == 2), self.start) + doc).astype(np.int32)
        del kind, inside, heads, joined
        names, code = np.unique(np.array(langs.to_pylist(), dtype=object).astype(str), return_inverse=True) if len(t) else (np.array([], dtype=str), doc)
        self.langs, self.lang = names.tolist(), code[doc].astype(np.int32) if len(doc) else doc
        seeds = np.array([xxhash.xxh3_64_intdigest(x.encode()) for x in self.langs], dtype=np.uint64)
        self.seed = seeds[self.lang] if len(doc) else np.empty(0, dtype=np.uint64)
        self.hash, self.check = np.empty((2, len(doc)), dtype=np.uint64)
        size = (self.end - self.start).astype(np.uint64)
        cuts = np.unique(np.append(np.searchsorted(self.start, np.arange(0, len(data), STRETCH)), len(doc)))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            first = self.start[a]
            part = self.text[first:self.end[b - 1]]
            for out, values in ((self.hash, _BYTE), (self.check, _BYTE_CHECK)):
                out[a:b] = _mixed(_spans(values[part], _BASE, self.start[a:b] - first, self.end[a:b] - first) + size[a:b])

    def phrases(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each word that starts n words of one piece: its place, their fingerprint and check."""
        m = len(self.start) - n + 1
        if m <= 0:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.uint64)
        at = np.flatnonzero(self.piece[:m] == self.piece[n - 1:])
        fp = _mixed(_spans(self.hash, _WORD_BASE, at, at + n) ^ self.seed[at])
        return at, fp, _mixed(_spans(self.check, _WORD_BASE, at, at + n) + self.seed[at]) >> np.uint64(32)

    def spelled(self, at: int, n: int) -> str:
        return b" ".join(self.text[a:b].tobytes() for a, b in zip(self.start[at:at + n], self.end[at:at + n], strict=True)).decode()


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array ``known``."""
    if not len(known):
        return np.zeros(len(values), dtype=bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _groups(fp: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by (fp, check), and where each distinct pair starts in it."""
    order = np.argsort(fp, kind="stable")
    f, c = fp[order], check[order]
    same = f[1:] == f[:-1]
    if (same & (c[1:] != c[:-1])).any():
        order = np.lexsort((check, fp))
        f, c = fp[order], check[order]
        same = f[1:] == f[:-1]
    return order, np.flatnonzero(np.concatenate([np.ones(min(len(f), 1), dtype=bool), ~(same & (c[1:] == c[:-1]))]))


def _joined(column: pa.ChunkedArray, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype)


class _Level:
    """The steps of one phrase length; ``bits`` shortens fingerprints and checks, for tests of collisions."""

    def __init__(self, n: int, buckets: int, min_count: int, bits: tuple[int, int]):
        self.n, self.buckets, self.min_count, self.bits = n, buckets, min_count, bits

    def phrases(self, words: Words, n: int):
        at, fp, check = words.phrases(n)
        return at, fp & np.uint64((1 << self.bits[0]) - 1) if self.bits[0] < 64 else fp, check & np.uint64((1 << self.bits[1]) - 1)

    def sent(self, docs: pa.Table, marks: pa.Table | None) -> pa.Table:
        """The block's distinct phrases with their counts, a row for each bucket."""
        block = docs.column("block")[0].as_py() if docs.num_rows else 0
        words = _words(docs)
        at, fp, check = self.phrases(words, self.n)
        if marks is not None:
            before, shorter, _ = self.phrases(words, self.n - 1)
            frequent = np.zeros(len(words.start) + 1, dtype=bool)
            frequent[before[_among(shorter, np.unique(_joined(marks.column("fps"), np.uint64)))]] = True
            keep = frequent[at] & frequent[at + 1]
            fp, check = fp[keep], check[keep]
        order, first = _groups(fp, check)
        count = np.diff(np.append(first, len(order))).astype(np.int64)
        fp, check = fp[order[first]], check[order[first]].astype(np.uint32)
        edge = np.searchsorted((fp >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32), np.arange(self.buckets + 1))
        some = np.flatnonzero(np.diff(edge))
        spans = [slice(edge[b], edge[b + 1]) for b in some]
        return pa.table([pa.array([self.n] * len(some), pa.int32()), pa.array(some, pa.int32()), pa.array([block] * len(some), pa.int64()),
                         *[pa.array([x[s].tobytes() for s in spans], pa.binary()) for x in (fp, check, count.astype(np.uint32))]], names=["level", "bucket", "block", "fps", "checks", "counts"])

    def met(self, blobs: pa.Table) -> pa.Table:
        """Frequent phrases of a bucket: for each block which it holds, and which it has to spell out."""
        sizes = np.array([len(x) // 8 for x in blobs.column("fps").to_pylist()])
        names = blobs.column("block").to_numpy()
        fp, check, count = (_joined(blobs.column(c), t) for c, t in (("fps", np.uint64), ("checks", np.uint32), ("counts", np.uint32)))
        place = np.repeat(np.arange(len(sizes)), sizes)
        order, first = _groups(fp, check)
        total = np.add.reduceat(count[order].astype(np.int64), first)
        member = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
        owner = place[order]
        # Of several blocks the two ends of the block numbers spell the phrase.
        low, high = (f(names[owner], first) for f in (np.minimum.reduceat, np.maximum.reduceat))
        frequent = (total >= self.min_count)[member]
        order, member, owner = order[frequent], member[frequent], owner[frequent]
        by = np.lexsort((fp[order], owner))
        order, member, owner = order[by], member[by], owner[by]
        spell = (names[owner] == low[member]) | (names[owner] == high[member])
        edge = np.searchsorted(owner, np.arange(len(sizes) + 1))
        some = np.flatnonzero(np.diff(edge))
        rows = []
        for k in some:
            s = slice(edge[k], edge[k + 1])
            own = spell[s]
            rows.append((fp[order[s]].tobytes(), fp[order[s]][own].tobytes(), check[order[s]][own].tobytes(), total[member[s]][own].tobytes()))
        columns = list(zip(*rows, strict=True)) or [()] * 4
        return pa.table([pa.array([self.n] * len(some), pa.int32()), pa.array(names[some], pa.int64()), *[pa.array(c, pa.binary()) for c in columns]], names=["level", "block", "fps", "own", "own_checks", "own_counts"])


def _steps(level: _Level):
    def first(docs: pa.Table) -> pa.Table:
        return level.sent(docs, None)

    def later(docs: pa.Table, marks: pa.Table) -> pa.Table:
        return level.sent(docs, marks)

    def met(blobs: pa.Table) -> pa.Table:
        return level.met(blobs)

    return first, later, met


def _table(rows: list[tuple]) -> pa.Table:
    types = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    return pa.table([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 6, types, strict=True)], names=["level", "fp", "check", "lang", "phrase", "a"])


def _spell(level: _Level, longest: int):
    """Text of the phrases that a block has to spell out; as level 0 its words by language."""
    def run(docs: pa.Table, marks: pa.Table) -> pa.Table:
        words = _words(docs)
        rows = [(0, 0, 0, words.langs[k], "", int(n)) for k, n in enumerate(np.bincount(words.lang, minlength=len(words.langs))) if n]
        levels = marks.column("level").to_numpy()
        for n in range(1, longest + 1):
            mine = marks.filter(pa.array(levels == n))
            own, checks, counts = (_joined(mine.column(c), t) for c, t in (("own", np.uint64), ("own_checks", np.uint32), ("own_counts", np.int64)))
            by = np.lexsort((checks, own))
            own, checks, counts = own[by], checks[by].astype(np.uint64), counts[by]
            at, fp, check = level.phrases(words, n)
            here = _among(fp, own)
            at, fp, check = at[here], fp[here], check[here]
            k = np.searchsorted(own, fp)
            while len(at):
                hit = checks[k] == check
                places = at[hit]
                found, first = np.unique(k[hit], return_index=True)
                last = np.unique(k[hit][::-1], return_index=True)[1]
                for j, a, z in zip(found.tolist(), places[first].tolist(), places[::-1][last].tolist(), strict=True):
                    for text in sorted({(words.langs[words.lang[x]], words.spelled(x, n)) for x in (a, z)}):
                        rows.append((n, int(own[j].view(np.int64)), int(checks[j]), *text, int(counts[j])))
                # The rest has the fingerprint but another check.
                at, fp, check, k = at[~hit], fp[~hit], check[~hit], k[~hit] + 1
                more = k < len(own)
                more[more] = own[k[more]] == fp[more]
                at, fp, check, k = at[more], fp[more], check[more], k[more]
        return _table(rows)
    return run


def _recount(level: _Level, bad: dict[int, np.ndarray]):
    """Occurrences by text of all phrases with one of the given fingerprints."""
    def run(docs: pa.Table) -> pa.Table:
        words = _words(docs)
        rows = []
        for n, fps in bad.items():
            at, fp, _ = level.phrases(words, n)
            count = Counter((words.langs[words.lang[a]], words.spelled(a, n)) for a in at[_among(fp, fps)].tolist())
            rows += [(n, 0, 0, lang, text, c) for (lang, text), c in count.items()]
        return _table(rows)
    return run


def _placed(chunks: DataFrame, n_blocks: int) -> DataFrame:
    """The chunks dealt by block and materialised so that later steps by block find them in place."""
    conf = chunks.sparkSession.conf
    parts = min(n_blocks, int(conf.get("spark.sql.shuffle.partitions")))
    adaptive = conf.get("spark.sql.adaptive.enabled")
    # An adaptive plan does not say how its result is partitioned; a step by block would deal it again.
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return runtime.checkpoint(chunks.repartition(parts, "block"))
    finally:
        conf.set("spark.sql.adaptive.enabled", adaptive)


def frequent_phrases(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, text_col: str = "text", lang_col: str = "lang", block: int = BLOCK, bits: tuple[int, int] = (64, 32)) -> DataFrame:
    """``lang, words, phrase, a``: phrases of 1 to ``longest`` words that occur ``min_count`` times; as 0 words all words.

    A-Z are lower-cased; pieces end at ``.,;:!?`` and line ends, words at spaces and tabs.
    Null texts are empty, null languages ``und``.  Equal rows count each; other columns are
    ignored.  A document is in one block, however long it is.
    """
    d = docs.select(F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    total = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-total // block))
    blocks = _placed(d.mapInArrow(_chunks, _CHUNKS).withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_blocks))), n_blocks)
    by_block, marks, every = blocks.groupBy("block"), None, None
    for n in range(1, longest + 1):
        level = _Level(n, n_blocks, min_count, bits)
        first, later, met = _steps(level)
        blobs = by_block.applyInArrow(first, _BLOBS) if marks is None else by_block.cogroup(marks.groupBy("block")).applyInArrow(later, _BLOBS)
        marks = runtime.checkpoint(blobs.groupBy("bucket").applyInArrow(met, _MARKS))
        every = marks if every is None else every.unionByName(marks)
    spelled = by_block.cogroup(every.filter(F.octet_length("own") > 0).drop("fps").groupBy("block")).applyInArrow(_spell(level, longest), _FOUND)
    one = runtime.checkpoint(spelled.groupBy("level", "fp", "check", F.when(F.col("level") == 0, F.col("lang")).alias("of"))
                             .agg(F.sum("a").alias("sum"), F.min("a").alias("a"), F.min(F.struct("lang", "phrase")).alias("t"), F.max(F.struct("lang", "phrase")).alias("u")))
    out = one.select("t.lang", F.col("level").alias("words"), "t.phrase", F.when(F.col("level") == 0, F.col("sum")).otherwise(F.col("a")).alias("a"))
    mixed = one.filter("t <> u").select("level", "fp").distinct()
    bad: dict[int, list[int]] = {}
    for r in mixed.collect():
        bad.setdefault(r.level, []).append(r.fp)
    if bad:
        again = by_block.applyInArrow(_recount(level, {n: np.sort(np.array(x, dtype=np.int64).view(np.uint64)) for n, x in bad.items()}), _FOUND)
        again = again.groupBy("lang", F.col("level").alias("words"), "phrase").agg(F.sum("a").alias("a")).filter(F.col("a") >= min_count)
        out = one.join(mixed, ["level", "fp"], "left_anti").select("t.lang", F.col("level").alias("words"), "t.phrase", F.when(F.col("level") == 0, F.col("sum")).otherwise(F.col("a")).alias("a")).unionByName(again)
    return out


def _runs(phrase: Column) -> Column:
    """All shorter runs of at least two words of a phrase."""
    w = F.split(phrase, " ")
    return F.flatten(F.transform(F.sequence(F.lit(2), F.size(w) - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))))


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, top: int = TOP, inside: int = INSIDE, text_col: str = "text", lang_col: str = "lang", block: int = BLOCK, bits: tuple[int, int] = (64, 32)) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``top`` phrases of 2 to ``longest`` words.

    a, l and r count the phrase, and the first and the other part of its weakest cut; n
    counts all words; the score is 2,000,000 a / (l + r), rounded down.  Phrases of which
    ``inside`` percent lie in one longer frequent phrase are dropped.  Input as in
    ``frequent_phrases``; texts without words and empty tables give no rows.
    """
    found = runtime.checkpoint(frequent_phrases(docs, min_count, longest, text_col, lang_col, block, bits))
    counts = found.filter("words > 0").select("lang", "words", "phrase", "a")
    cut = counts.filter("words > 1").select("lang", "words", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cut = cut.withColumn("first", F.expr("substring_index(phrase, ' ', k)")).withColumn("rest", F.expr("substring_index(phrase, ' ', k - words)"))
    cut = (cut.join(counts.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l")), ["lang", "first"])
           .join(counts.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r")), ["lang", "rest"])
           .withColumn("score", F.expr("cast(cast(2000000 as decimal(10,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as bigint)")))
    best = cut.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("c"))
    longer = counts.filter("words > 2").select("lang", "a", F.explode(_runs(F.col("phrase"))).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(longer, ["lang", "phrase"], "left").filter(F.expr(f"longer is null or 100 * longer < {inside} * a")).select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    # First the best of shares of each language, then of these.
    order = [F.desc("score"), F.desc("a"), "phrase"]
    shares = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = kept.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(shares)))
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).filter(F.col("rank") <= top)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).filter(F.col("rank") <= top)
    words = found.filter("words = 0").select("lang", F.col("a").alias("n"))
    return kept.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
