"""Near duplicates by a chosen-path set similarity join.

A document's set is its distinct word shingles.  Documents with equal sets are one class,
and one of each class goes on.  Every independent tree starts with all of them and splits
a node by the values of a minwise coordinate that the node itself selects (sometimes two,
1.25 on average), so documents meet in a child when the selected minwise tokens are equal.
A node that is small is compared exhaustively; a large one is split further.

Groups of mutual near copies do not get smaller by splitting.  So large nodes first
propose their members with one of them, drawn in each node, as partner; these links are
confirmed and their components are taken out: a node with one component is done, and a
node counts as small when few members are outside its largest component.  Those few are
compared with the whole node, whatever its size.  Nodes that are still mixed after a split
and have up to ``GROUP`` members are compared exhaustively in one task, on the full sets;
larger ones are split on.

Proposed pairs pass a test of sizes and of 128 minwise bytes (which loses a pair of
similarity 0.8 less than once in ten million) and are then confirmed on the full sets.
A pair of similarity 0.8 survives to depth 3 of a tree with probability 0.64 and to depth
6 with 0.48; ``TREES`` trees miss it less than once in a hundred thousand.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsflow.llm.components import components
from obsflow.llm.texts import map_arrays, map_rows, mixed, window_hashes, word_hashes, word_list
from obsflow.plans import runtime

COORDINATES = 128
TREES = 20
# Members outside the largest component up to which a node is compared exhaustively.
LEAF = 24
# A mixed node below the roots is compared by one task up to so many members and shingles
# (about 100 MB for their counts and 64 MB for their sets).
GROUP = 4096
GROUP_SHINGLES = 8_000_000
# Depth from which on every node is compared, so that the recursion ends.
DEPTH = 24
# Partners per verification group; more are dealt over several groups.
SPOKES = 256
_A = np.random.default_rng(20240229).integers(0, 1 << 63, COORDINATES, dtype=np.int64).view(np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles of the lower-cased (A-Z) words; with fewer words, of the whole sequence."""
    raw = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not raw:
        return np.empty(0, dtype=np.uint64)
    return np.unique(window_hashes(word_hashes(raw), min(words, len(raw))) ^ np.uint64(min(words, len(raw))))


def minwise(s: np.ndarray) -> np.ndarray:
    out = np.full(COORDINATES, np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(s), 256):
            out = np.minimum(out, (s[at:at + 256, None] * _A).min(axis=0))
    return (out >> np.uint64(32)).astype(np.uint32)


def _child(node: np.ndarray, coordinate: np.ndarray, sig: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(node * np.uint64(0x9E3779B97F4A7C15) + (sig[coordinate].astype(np.uint64) << np.uint64(8)) + coordinate.astype(np.uint64))


def roots(sig: np.ndarray) -> np.ndarray:
    """First-level nodes of all trees: tree r selects its own coordinate, every fourth tree two."""
    r = np.arange(TREES, dtype=np.int64)
    step = COORDINATES // TREES
    two = r[::4]
    trees = np.concatenate([r, two])
    return _child(mixed(trees.astype(np.uint64) + np.uint64(1)), np.concatenate([r * step, two * step + step // 2]), sig)


def children(nodes: np.ndarray, sig: np.ndarray) -> np.ndarray:
    """Each node selects one coordinate, a quarter of them two."""
    r = mixed(nodes ^ np.uint64(0x5851F42D4C957F2D))
    one = (r % np.uint64(COORDINATES)).astype(np.int64)
    more = (r >> np.uint64(60)) < 4
    two = ((one[more] + 1 + ((r[more] >> np.uint64(20)) % np.uint64(COORDINATES - 1)).astype(np.int64)) % COORDINATES)
    return np.concatenate([_child(nodes, one, sig), _child(nodes[more], two, sig)])


def _few(batches):
    """The rows in small batches: sets of long documents are large."""
    for b in batches:
        for at in range(0, b.num_rows, 64):
            yield b.slice(at, 64)


def _prints(docs: DataFrame, words: int) -> DataFrame:
    def make():
        def f(doc, text):
            s = shingle_set(text, words)
            if not len(s):
                yield doc, 0, None, None
            else:
                yield doc, len(s), xxhash.xxh3_128_digest(s.tobytes()), minwise(s).tobytes()
        return f

    return map_rows(docs, make, "doc_id bigint, n bigint, digest binary, sig binary")


def _level(classes: DataFrame, active: DataFrame | None) -> DataFrame:
    """``node, doc_id, n`` of the children of the active nodes (``doc_id, nodes``), or of the roots."""
    if active is None:
        def first():
            def f(doc, n, sig):
                k = roots(np.frombuffer(sig, dtype=np.uint32)).view(np.int64)
                return k, np.full(len(k), doc), np.full(len(k), n, dtype=np.int32)
            return f
        return map_arrays(classes.select("doc_id", "n", "sig"), first, "node bigint, doc_id bigint, n int")

    def further():
        def f(doc, n, sig, nodes):
            k = np.unique(children(np.array(nodes, dtype=np.int64).view(np.uint64), np.frombuffer(sig, dtype=np.uint32))).view(np.int64)
            return k, np.full(len(k), doc), np.full(len(k), n, dtype=np.int32)
        return f
    return map_arrays(classes.join(runtime.small(active), "doc_id").select("doc_id", "n", "sig", "nodes"), further, "node bigint, doc_id bigint, n int")


def _similar(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose minwise bytes agree often enough to be worth confirming."""
    short = classes.select("doc_id", "bytes")
    least = int(COORDINATES * (percent / 100 - 0.2))

    def run(batches):
        for b in batches:
            x = np.frombuffer(b"".join(b.column(2).to_pylist()), dtype=np.uint8).reshape(-1, COORDINATES)
            y = np.frombuffer(b"".join(b.column(3).to_pylist()), dtype=np.uint8).reshape(-1, COORDINATES)
            keep = pa.array((x == y).sum(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["a", "b"])

    full = pairs.join(short.withColumnsRenamed({"doc_id": "b", "bytes": "y"}), "b").join(short.withColumnsRenamed({"doc_id": "a", "bytes": "x"}), "a")
    return full.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def _confirmed(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs that reach the similarity on their full sets; ``pairs`` is materialised and distinct.

    The end with more partners is the hub.  Sets travel to their hub's group, at most
    ``SPOKES`` to one group, and are compared with the hub's set as they stream by.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count("*").alias("deg"))
    named = (pairs.join(ends.withColumnsRenamed({"v": "a", "deg": "da"}), "a").join(ends.withColumnsRenamed({"v": "b", "deg": "db"}), "b")
             .select(F.when(F.col("da") >= F.col("db"), F.struct(F.col("a").alias("hub"), F.col("b").alias("doc_id"), F.col("da").alias("deg")))
                     .otherwise(F.struct(F.col("b").alias("hub"), F.col("a").alias("doc_id"), F.col("db").alias("deg"))).alias("h")).select("h.*"))
    spokes = named.select("hub", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("deg") / SPOKES)).cast("int").alias("block"), "doc_id")
    members = spokes.union(spokes.select("hub", "block", F.col("hub").alias("doc_id")).distinct())
    # A document of very many groups is listed in several rows.
    listed = (members.groupBy("doc_id", F.pmod(F.xxhash64("hub", "block"), F.lit(64)).alias("salt")).agg(F.collect_list(F.struct("hub", "block")).alias("groups")).drop("salt"))

    def sets():
        def f(doc, text, groups):
            s = shingle_set(text, words).tobytes()
            for g in groups:
                yield g["hub"], g["block"], doc, g["hub"] != doc, s
        return f

    dealt = (map_rows(docs.join(runtime.small(listed), "doc_id").select("doc_id", "text", "groups"), sets, "hub bigint, block int, doc_id bigint, spoke boolean, s binary", rows=256)
             .repartition("hub", "block").sortWithinPartitions("hub", "block", "spoke"))

    def compare(batches):
        key, own = None, []
        for b in _few(batches):
            out: list[tuple[int, int]] = []
            for hub, block, doc, spoke, s in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key != (hub, block):
                    key, own = (hub, block), []
                x = np.frombuffer(s, dtype=np.uint64)
                if not spoke:
                    own.append(x)
                    continue
                for y in own:
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        out.append((hub, doc))
                        break
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    return dealt.mapInArrow(compare, "a bigint, b bigint")


def _exhausted(members: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Links that join the components of each node of ``members`` (node, doc_id, comp), on the full sets of all its members.

    Intersection sizes of all pairs are a matrix product over the shingles that at least
    two members have.
    """
    listed = members.groupBy("doc_id").agg(F.collect_set(F.struct("node", "comp")).alias("groups"))

    def sets():
        def f(doc, text, groups):
            s = shingle_set(text, words).tobytes()
            for g in groups:
                yield g["node"], doc, g["comp"], s
        return f

    dealt = (map_rows(docs.join(runtime.small(listed), "doc_id").select("doc_id", "text", "groups"), sets, "node bigint, doc_id bigint, comp bigint, s binary", rows=256)
             .repartition("node").sortWithinPartitions("node"))

    def joined(group) -> list[tuple[int, int]]:
        own = [np.frombuffer(s, dtype=np.uint64) for _, _, s in group]
        size = np.array([len(s) for s in own], dtype=np.float64)
        values, column, often = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(own)), size.astype(np.int64))
        place = np.cumsum(often > 1) - 1
        keep = often[column] > 1
        row, column = row[keep], place[column[keep]]
        both = np.zeros((len(own), len(own)), dtype=np.float32)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for at in range(0, int((often > 1).sum()), 2048):
            lo, hi = np.searchsorted(column, [at, at + 2048])
            part = np.zeros((len(own), 2048), dtype=np.float32)
            part[row[lo:hi], column[lo:hi] - at] = 1
            both += part @ part.T
        label = np.array([c for _, c, _ in group])
        out = []
        for i in range(len(own)):
            shared = both[i].astype(np.float64)
            j = np.flatnonzero((100 * shared >= percent * (size[i] + size - shared)) & (label != label[i]))
            for c, first in zip(*np.unique(label[j], return_index=True), strict=True):
                out.append((group[i][0], group[int(j[first])][0]))
                label[label == c] = label[i]
        return out

    def compare(batches):
        key, group = None, []

        def links():
            got = joined(group) if len(group) > 1 else []
            return [pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*got, strict=True)], names=["a", "b"])] if got else []

        for b in _few(batches):
            for node, *member in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if node != key:
                    yield from links()
                    key, group = node, []
                group.append(tuple(member))
        yield from links()

    return dealt.mapInArrow(compare, "a bigint, b bigint")


def _links(docs: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    rows = _level(classes, None)
    sizes = rows.groupBy("node").agg(F.count("*").alias("size"), F.min(F.struct(F.xxhash64("node", "doc_id"), "doc_id", "n")).alias("pivot")).filter("size > 1")
    rows = runtime.checkpoint(rows.join(sizes, "node"))
    fit = F.expr(f"100 * least(n, m) >= {percent} * greatest(n, m)")
    stars = rows.filter(F.col("size") > LEAF).select(F.col("pivot.doc_id").alias("p"), "doc_id", "n", F.col("pivot.n").alias("m")).filter("p <> doc_id").filter(fit)
    stars = stars.select(F.least("p", "doc_id").alias("a"), F.greatest("p", "doc_id").alias("b")).distinct()
    found = runtime.checkpoint(_confirmed(runtime.checkpoint(_similar(stars, classes, percent)), docs, words, percent))
    label = runtime.small(runtime.checkpoint(components(found).withColumnsRenamed({"node": "doc_id", "component": "comp"})))

    links, pairs = [found], []
    rows = rows.select("node", "doc_id", "n")
    for depth in range(1, DEPTH + 1):
        rows = rows.join(label, "doc_id", "left").select("node", "doc_id", "n", F.coalesce("comp", "doc_id").alias("comp"))
        if depth > 1:  # used by the counts and with them
            rows = runtime.checkpoint(rows)
        stat = (rows.groupBy("node", "comp").agg(F.count("*").alias("c"), F.sum(F.col("n").cast("bigint")).alias("s")).groupBy("node")
                .agg(F.max(F.struct("c", "comp")).alias("top"), (F.sum("c") - F.max("c")).alias("others"),
                     ((F.sum("c") <= GROUP) & (F.sum("s") <= GROUP_SHINGLES)).alias("fits")).filter("others > 0")
                .select("node", F.col("top.comp").alias("main"), "others", "fits"))
        rows = runtime.checkpoint(rows.join(stat, "node"))
        few = F.lit(True) if depth == DEPTH else F.col("others") <= LEAF
        done = rows.filter(few)
        other = done.filter("comp <> main").select("node", F.col("doc_id").alias("x"), F.col("n").alias("m"), F.col("comp").alias("xc"))
        met = done.join(other, "node").filter("comp <> xc and (comp = main or doc_id < x)").filter(fit)
        pairs.append(runtime.checkpoint(met.select(F.least("doc_id", "x").alias("a"), F.greatest("doc_id", "x").alias("b")).distinct()))
        rest = rows.filter(~few)
        if rest.isEmpty():
            break
        if depth > 1:
            links.append(runtime.checkpoint(_exhausted(rest.filter("fits"), docs, words, percent)))
            rest = rest.filter("not fits")
            if rest.isEmpty():
                break
        rows = _level(classes, runtime.checkpoint(rest.groupBy("doc_id").agg(F.collect_set("node").alias("nodes"))))
    met = pairs[0]
    for p in pairs[1:]:
        met = met.union(p)
    links.append(_confirmed(runtime.checkpoint(_similar(met.distinct(), classes, percent)), docs, words, percent))
    out = links[0]
    for x in links[1:]:
        out = out.union(x)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs``.

    Rows are linked where the sets' intersection is at least ``percent`` per cent of their
    union.  ``component_id`` is the smallest id a row reaches by links; the rows with that
    id are kept.  Null, empty and white-space texts have no set and no links.  Equal texts
    are linked through their class.  Rows with the same id count as one document and share
    a component.  Rows with a null id are not linked, have a null component and are kept.
    Other columns are ignored.
    """
    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    prints = runtime.checkpoint(_prints(d, words))
    usable = prints.filter("n > 0 and doc_id is not null")
    classes = usable.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    member = runtime.checkpoint(usable.select("doc_id", "digest").join(classes.select("digest", F.col("doc_id").alias("class")), "digest").select("doc_id", "class").distinct())

    def low(batches):
        for b in batches:
            sig = np.frombuffer(b"".join(b.column(2).to_pylist()), dtype=np.uint32).reshape(-1, COORDINATES)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([r.tobytes() for r in (sig & 255).astype(np.uint8)], type=pa.binary())], names=["doc_id", "n", "sig", "bytes"])

    classes = runtime.checkpoint(classes.select("doc_id", "n", "sig").mapInArrow(low, "doc_id bigint, n bigint, sig binary, bytes binary"))
    links = _links(d.filter("doc_id is not null"), classes, words, percent)
    # An id in several classes (rows that share an id) joins them.
    comp = components(links.union(member.select(F.col("class").alias("a"), F.col("doc_id").alias("b")).filter("a <> b")))
    out = prints.select("doc_id", F.col("n").alias("n_shingles")).join(comp.withColumnsRenamed({"node": "doc_id"}), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"),
                      F.coalesce(F.col("component").isNull() | (F.col("component") == F.col("doc_id")), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, with all their columns.

    Of rows with the same id and text one stays.  Rows with a null id or without words all stay.
    """
    found = near_duplicates(docs, id_col, text_col, words, percent)
    gone = runtime.small(runtime.checkpoint(found.filter(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()))
    rest = docs.join(gone, F.col(id_col).cast("bigint") == F.col("_gone"), "left_anti")
    again = runtime.checkpoint(found.filter("doc_id is not null and n_shingles > 0").groupBy(F.col("doc_id").alias("_again")).agg(F.count("*").alias("_n")).filter("_n > 1").select("_again"))
    if again.isEmpty():
        return rest
    same = F.col(id_col).cast("bigint") == F.col("_again")
    again = runtime.small(again)
    twice = rest.join(again, same, "left_semi").withColumn("_text_hash", F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256))
    return rest.join(again, same, "left_anti").unionByName(twice.dropDuplicates([id_col, "_text_hash"]).drop("_text_hash"))


def components_by_rule(texts: dict[int, str | None], words: int = 5, percent: int = 80) -> dict[int, tuple[int, int]]:
    """Set size and component of each text by comparing all pairs of word tuples, for tests."""
    sets = {}
    for i, t in texts.items():
        w = [x.lower() for x in word_list(t)]
        sets[i] = {tuple(w[k:k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    up = {i: i for i in texts}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(texts)
    for i in ids:
        for j in ids:
            if i < j and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    a, b = sorted((root(i), root(j)))
                    up[b] = a
    return {i: (len(sets[i]), root(i)) for i in ids}
