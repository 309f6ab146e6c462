"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece the table keeps the last token of the prefix's only valid
encoding (``prefixes``).  The table of a prefix never changes when
bytes are appended, so appends continue it, and after an edit it is recomputed only from
the edit to the point where it agrees with the old one again.
"""

from __future__ import annotations

import base64
from itertools import chain

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsflow.llm.prefixes import Merges, Recent
from obsflow.llm.texts import map_rows, worker_state


class Vocabulary:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {i: t for t, i in self.ranks.items()}
        self.merges = Merges({t.decode("latin-1"): i for t, i in self.ranks.items()})
        self.longest = self.merges.longest
        self.split = regex.compile(pattern).findall
        self.spans = regex.compile(pattern).finditer
        self.texts = {i: str(i) for i in self.bytes_of}
        self._pieces = Recent(self.encode_piece)

    def merge(self, piece: bytes) -> list[int]:
        """BPE as defined: again and again join the leftmost adjacent pair of lowest rank."""
        return [self.ranks[p.encode("latin-1")] for p in self.merges.merge(piece.decode("latin-1"))]

    def extend(self, piece: bytes, last: list[int]) -> list[int]:
        """The table of last tokens of ``piece``, given that of one of its prefixes; -1: no token fits."""
        return self.merges.extend(piece.decode("latin-1"), last)

    def walk(self, last: list[int]) -> list[int] | None:
        """The tokens of the whole table, from its end to its start."""
        out, at = [], len(last)
        while at:
            token = last[at - 1]
            if token < 0:
                return None
            out.append(token)
            at -= len(self.bytes_of[token])
        return out[::-1]

    def tokens_of(self, piece: bytes, last: list[int]) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        return self.walk(last) or self.merge(piece)

    def edit(self, old: bytes, last: list[int], start: int, end: int, new: bytes) -> tuple[bytes, list[int]]:
        """Table after ``old[start:end]`` is replaced by ``new``.

        A token is at most ``longest`` bytes long, so once that many entries in a row equal
        the old ones all later ones do.
        """
        piece = old[:start] + new + old[end:]
        shift, size = len(piece) - len(old), self.longest
        table, first, at = last[:start], start + len(new), start + len(new)
        while at < len(piece):
            at = min(len(piece), at + 2 * size)
            table = self.extend(piece[:at], table)
            if at - size >= first and table[at - size:] == last[at - size - shift:at - shift]:
                return piece, table + last[at - shift:]
        return piece, self.extend(piece, table)

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode("utf-8", "replace")
        return tuple(self.tokens_of(raw, [] if raw in self.ranks else self.extend(raw, [])))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self._pieces.__getitem__, self.split(text))))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def table(self, text: str) -> list[tuple[int, str, list[int]]]:
        """Pieces of the text: where each starts, itself, its table of last tokens."""
        return [(m.start(), m[0], self.extend(m[0].encode("utf-8", "replace"), [])) for m in self.spans(text)]

    def revise(self, text: str, table, start: int, end: int, new: str):
        """Text and table after ``text[start:end]`` is replaced; an append is ``start == end == len(text)``.

        Where a piece ends can depend on what follows it, and contractions reach over two
        pieces, so splitting starts two pieces before the edit.  It stops at the first
        boundary behind the edit that was a boundary before.
        """
        changed = text[:start] + new + text[end:]
        shift = len(changed) - len(text)
        keep = max(0, sum(1 for s, p, _ in table if s + len(p) <= start) - 2)
        begin = table[keep][0] if keep < len(table) else (table[-1][0] if table else 0)
        if keep >= len(table) and table:
            keep = len(table) - 1
        out = table[:keep]
        old = {s: k for k, (s, _, _) in enumerate(table)}
        for m in self.spans(changed, begin):
            k = old.get(m.start() - shift)
            if m.start() >= start + len(new) and k is not None:
                return changed, out + [(s + shift, p, t) for s, p, t in table[k:]]
            before = table[old[m.start()]] if m.start() in old and m.start() < start else None
            raw = m[0].encode("utf-8", "replace")
            have: list[int] = []
            if before:  # the same piece, perhaps longer or changed inside
                b = before[1].encode("utf-8", "replace")
                same = next((i for i, (x, y) in enumerate(zip(b, raw, strict=False)) if x != y), min(len(b), len(raw)))
                have = before[2][:same]
            out.append((m.start(), m[0], self.extend(raw, have)))
        return changed, out

    def ids(self, table) -> list[int]:
        return [i for _, p, t in table for i in self.tokens_of(p.encode("utf-8", "replace"), t)]


def vocabulary(path: str, pattern: str) -> Vocabulary:
    state = worker_state("bpe")
    key = ("bpe", path, pattern)
    if key not in state:
        state[key] = Vocabulary(path, pattern)
    return state[key]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` of every row; null and empty texts have no ids.  ``path`` must exist on all workers."""
    def make():
        v = vocabulary(path, pattern)

        def f(doc, text):
            yield doc, v.encode(text or "")
        return f

    return map_rows(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")), make, "doc_id bigint, ids array<int>", rows=64)


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, bytes`` of rows ``doc_id, ids``; null ids give no bytes."""
    def make():
        v = vocabulary(path, pattern)

        def f(doc, ids):
            yield doc, v.decode(ids or ())
        return f

    return map_rows(tokens.select("doc_id", "ids"), make, "doc_id bigint, bytes binary", rows=64)


def reencode(edits: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, text, ids`` after edits ``doc_id, text, start, end, new`` (code points; null text: empty).

    Positions outside the text are moved to its ends, a null ``new`` deletes.
    """
    def make():
        v = vocabulary(path, pattern)

        def f(doc, text, start, end, new):
            text = text or ""
            start = min(max(start or 0, 0), len(text))
            end = min(max(end if end is not None else start, start), len(text))
            changed, table = v.revise(text, v.table(text), start, end, new or "")
            yield doc, changed, v.ids(table)
        return f

    return map_rows(edits.select("doc_id", "text", "start", "end", "new"), make, "doc_id bigint, text string, ids array<int>", rows=64)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: each text encoded and its ids decoded, in one pass.

    Null and empty texts have no tokens and the hash of no bytes.  Repeated ids and rows
    are encoded each for itself; other columns are ignored.
    """
    import hashlib

    def make():
        v = vocabulary(path, pattern)
        write = v.texts.__getitem__

        def f(doc, text):
            ids = v.encode(text or "")
            yield doc, len(ids), hashlib.sha256(",".join(map(write, ids)).encode()).hexdigest(), hashlib.sha256(v.decode(ids)).hexdigest()
        return f

    return map_rows(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")), make,
                    "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids, decoded_sha256`` of every row, as ``round_trip`` with the ids themselves."""
    import hashlib

    def make():
        v = vocabulary(path, pattern)

        def f(doc, text):
            ids = v.encode(text or "")
            yield doc, len(ids), ids, hashlib.sha256(v.decode(ids)).hexdigest()
        return f

    return map_rows(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")), make,
                    "doc_id bigint, n_tokens bigint, ids array<int>, decoded_sha256 string", rows=64)
