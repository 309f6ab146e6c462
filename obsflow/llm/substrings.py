"""Removal of passages that already occur in an earlier document.

Every window of ``width`` words has a Rabin-Karp hash.  A word goes if it lies in a window
whose hash also occurs in a document with a smaller id.  So that only windows which can
repeat are exchanged, each window is first represented by its smallest hash of ``GRAM``
words (the same in every copy of the window, and shared by about 20 neighbouring windows);
windows whose representative occurs in one document only are unique and are not exchanged.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsflow.llm.texts import map_arrays, map_rows, window_hashes, word_hashes, word_list

GRAM = 8
# An anchor of more documents than this is spread, over at most so many join keys.
SHARED = 500
SPREAD = 64


def _anchors(hashes: np.ndarray, width: int) -> np.ndarray:
    """For every window the smallest hash of the short grams inside it (van Herk's block minima)."""
    gram = min(GRAM, width)
    g = window_hashes(hashes, gram)
    k = width - gram + 1
    n = len(g) - k + 1
    pad = -len(g) % k
    blocks = np.concatenate([g, np.full(pad, np.iinfo(np.uint64).max, dtype=np.uint64)]).reshape(-1, k)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[k - 1:k - 1 + n])


def _covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Words inside the union of the windows at ``starts``: which are removed."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return np.cumsum(edge[:-1]) > 0


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text`` of every row of ``docs``.

    Null and empty texts have no words and come back empty; texts shorter than ``width``
    words stay whole.  Of equal documents the one with the smallest id stays.  Rows with
    the same id are one document for "smaller id": they do not remove each other.  Rows
    with a null id are kept whole and remove nothing.  Other columns are ignored.
    """
    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if docs.select(id_col, text_col).dtypes == d.dtypes:
        # Without new names all uses of the texts are one exchange.
        d = docs.select(id_col, text_col)
    known = d.filter(F.col("doc_id").isNotNull())

    def anchors():
        def f(doc, text):
            words = word_list(text)
            if len(words) < width:
                return None
            a = np.unique(_anchors(word_hashes(words), width)).view(np.int64)
            return a, np.full(len(a), doc)
        return f

    seen = map_arrays(known, anchors, "anchor bigint, doc_id bigint")
    # What very many documents share is spread over several join keys.
    spread = F.least(F.lit(SPREAD), F.ceil(F.count("*") / SHARED)).cast("int").alias("spread")
    first = seen.groupBy("anchor").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), spread).filter("first < last")
    # Dealt by document before they are gathered: there is nothing to combine on the way.
    shared = (seen.join(first, "anchor").select("doc_id", "anchor", "first", "spread").repartition("doc_id").groupBy("doc_id")
              .agg(F.collect_list(F.struct("anchor", (F.col("first") < F.col("doc_id")).alias("later"), "spread")).alias("anchors")))
    local = known.join(shared, "doc_id", "left")

    def windows(later_only: bool):
        def make():
            def f(doc, text, marks):
                if not marks:
                    return None
                h = word_hashes(word_list(text))
                a = _anchors(h, width).view(np.int64)
                picked = sorted((m["anchor"], m["spread"]) for m in marks if m["later"] or not later_only)
                if not picked:
                    return None
                anchor, spread = np.array([p for p, _ in picked], dtype=np.int64), np.array([s for _, s in picked], dtype=np.int32)
                k = np.minimum(np.searchsorted(anchor, a), len(anchor) - 1)
                at = np.flatnonzero(anchor[k] == a).astype(np.int32)
                w, parts = window_hashes(h, width).view(np.int64)[at], spread[k[at]]
                if later_only:
                    return w, (doc % parts.astype(np.int64)).astype(np.int32), np.full(len(at), doc, dtype=np.int64), at
                w, one = np.unique(w, return_index=True)
                return w, parts[one], np.full(len(w), doc)
            return f
        return make

    marked = local.filter(F.col("anchors").isNotNull()).select("doc_id", "text", "anchors")
    counted = map_arrays(marked, windows(False), "window bigint, spread int, doc_id bigint").groupBy("window", "spread").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    counted = counted.select("window", F.explode(F.sequence(F.lit(0), F.col("spread") - 1)).alias("part"), "first")
    starts = (map_arrays(marked, windows(True), "window bigint, part int, doc_id bigint, start int").join(counted, ["window", "part"])
              .filter("first < doc_id").select("doc_id", "start").repartition("doc_id").groupBy("doc_id").agg(F.collect_list("start").alias("starts")))

    def cut():
        def f(doc, text, at):
            words = word_list(text)
            n = len(words)
            if at:
                gone = _covered(np.unique(np.array(at, dtype=np.int64)), width, n)
                words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
            yield doc, n, n - len(words), b" ".join(words).decode("utf-8", "surrogatepass")
        return f

    whole = known.join(starts, "doc_id", "left").select("doc_id", "text", "starts")
    unknown = d.filter(F.col("doc_id").isNull()).select("doc_id", "text", F.lit(None).cast("array<int>").alias("starts"))
    return map_rows(whole.unionByName(unknown), cut, "doc_id bigint, n_words bigint, n_removed bigint, kept_text string")


def digest(df: DataFrame) -> DataFrame:
    """The text replaced by its SHA-256."""
    return df.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def removed_by_rule(texts: dict[int, str | None], width: int = 50) -> dict[int, tuple[int, int, str]]:
    """The same by plain comparison of word tuples, for tests."""
    words = {i: word_list(t) for i, t in texts.items()}
    first: dict[tuple, int] = {}
    for i in sorted(words):
        for s in range(len(words[i]) - width + 1):
            first.setdefault(tuple(words[i][s:s + width]), i)
    out = {}
    for i, w in words.items():
        gone = {p for s in range(len(w) - width + 1) if first[tuple(w[s:s + width])] < i for p in range(s, s + width)}
        kept = [x for p, x in enumerate(w) if p not in gone]
        out[i] = len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()
    return out
