"""Exact token counts of every prefix of a text, by prefix dynamic programming.

The vocabulary is a SentencePiece BPE model with byte fallback.  A text starts with one
added space, spaces become a visible mark, and a symbol outside the vocabulary counts one
token for each of its UTF-8 bytes.  The table of a unit keeps the last token of each prefix
(``prefixes``) and with it the number of tokens of each prefix: one more than that of the
prefix in front of the last token.  No token reaches over the start of a unit, so counts of
units add up, and a prefix of the text has the tokens of the whole units in it and those of
the prefix of one unit.  Truncation and budgets are then answered from the stored counts.
"""

from __future__ import annotations

import re
from array import array
from itertools import accumulate
from operator import add

import numpy as np
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsflow.llm.prefixes import Merges, Recent
from obsflow.llm.texts import map_rows, worker_state

SPACE = "▁"
# What the library has to give for the rules above; a model that differs is refused.
_PROBES = ["", "a", " a", "  b", "A  b\tc\n", "Ａ ﬁ", SPACE + "x", "<s>y</s>", "z "]


def _packed(counts: list[int]) -> bytes | array:
    return bytes(counts) if len(counts) < 64 else array("i", counts)


class Counter:
    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = {}
        for i in range(model.get_piece_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
                names[model.id_to_piece(i)] = i
        scores = {i: model.get_score(i) for i in names.values()}
        place = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.merges = Merges(names, {i: place[s] for i, s in scores.items()})
        # Two symbols that no token has side by side: a token never reaches over that place.
        self.together = {t[i:i + 2] for t in names for i in range(len(t) - 1)}
        self.lines = not any("\n" in t for t in names)
        self.units = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+" if all(SPACE not in t.lstrip(SPACE) for t in names) else r"(?s:.+)").findall
        self._parts = Recent(self._part)
        self._tables = Recent(self.table)
        for probe in _PROBES:
            if self.total(probe) != len(model.encode(probe)):
                raise ValueError(f"{path}: not a BPE model without normalisation, with a leading space and byte fallback")

    def _part(self, part: str) -> bytes | array:
        if len(part) == 1:
            return bytes([1 if part in self.merges.ids else len(part.encode("utf-8", "surrogatepass"))])
        return _packed(self.merges.counts(part)[1:])

    def table(self, unit: str) -> bytes | array:
        """Token counts of all prefixes of a unit (a word: with the mark before it), from one symbol to the whole."""
        if not unit.startswith((SPACE, "\n")):
            unit = SPACE + unit
        together, begin, out = self.together, 0, None
        cuts = [i for i, two in enumerate(map(add, unit, unit[1:]), 1) if two not in together]
        if not cuts:
            return self._parts[unit]
        for i in [*cuts, len(unit)]:
            part = self._parts[unit[begin:i]]
            begin = i
            if out is None:
                out = list(part)
            else:
                before = out[-1]
                out += [before + n for n in part]
        return _packed(out)

    def _marked(self, text: str) -> list[str]:
        """Units of the text; each starts with a space or a new line, a single space not written out."""
        if not text:
            return []
        if self.lines and text[0] != " " and "  " not in text and SPACE not in text:
            return text.replace("\n", " \n").split(" ")
        return [u[1:] if u[1:2] not in (SPACE, "\n") else u for u in self.units(SPACE + text.replace(" ", SPACE))]

    def total(self, text: str) -> int:
        return sum([t[-1] for t in map(self._tables.__getitem__, self._marked(text))])

    def counts(self, text: str) -> np.ndarray:
        """``counts[k]``: tokens of ``text[:k]`` encoded by itself, for k from 0 to the whole text."""
        tables = list(map(self._tables.__getitem__, self._marked(text)))
        before = accumulate((t[-1] for t in tables), initial=0)
        parts = [np.frombuffer(t, dtype=np.uint8 if isinstance(t, bytes) else np.int32).astype(np.int32) + b for t, b in zip(tables, before, strict=False)]
        out = np.concatenate(parts) if parts else np.zeros(1, dtype=np.int32)
        # Position 0 holds the added space, which an empty text does not get.
        out[0] = 0
        return out


def counter(path: str) -> Counter:
    state = worker_state("tokens")
    if path not in state:
        state[path] = Counter(path)
    return state[path]


def fitting(counts: np.ndarray, budget: int) -> int:
    """Length of the longest prefix of at most ``budget`` tokens (counts may fall when a symbol is added)."""
    return int(np.flatnonzero(counts <= budget)[-1]) if budget >= 0 else 0


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def token_counts(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row: the count of the longest prefix, the text itself.

    Null and empty texts have no bytes and no tokens.  Rows with equal or null ids are
    counted each for itself; other columns are ignored.  ``path`` must exist on all workers.
    """
    def make():
        c = counter(path)

        def f(doc, text):
            n = c.total(text or "")
            yield doc, len((text or "").encode("utf-8", "surrogatepass")), n, n > limit
        return f

    return map_rows(_texts(docs, id_col, text_col), make, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean", rows=64)


def prefix_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, counts``: entry k + 1 of ``counts`` (from 1) has the tokens of the first k code points.

    Null texts come back null with the one count 0 of an empty text.  ``fitting_length``,
    ``prefix_tokens`` and ``over_budget`` answer from the stored counts.
    """
    def make():
        c = counter(path)

        def f(doc, text):
            yield doc, text, c.counts(text or "").tolist()
        return f

    return map_rows(_texts(docs, id_col, text_col), make, "doc_id bigint, text string, counts array<int>", rows=16)


def fitting_length(counts: Column, budget: Column | int) -> Column:
    """Code points of the longest prefix within the budget, from stored counts; 0 for a negative budget.

    Without a search by halves, as a count may fall when a symbol is added.
    """
    budget = F.lit(budget)
    return F.size(counts) - 1 - F.coalesce(F.nullif(F.array_position(F.transform(F.reverse(counts), lambda c: c <= budget), True), F.lit(0)) - 1, F.size(counts) - 1).cast("int")


def prefix_tokens(counts: Column, length: Column | int) -> Column:
    """Tokens of the first ``length`` code points; lengths beyond the text mean the whole text."""
    return F.element_at(counts, (F.least(F.greatest(F.lit(length), F.lit(0)), F.size(counts) - 1) + 1).cast("int"))


def truncated(docs: DataFrame, path: str, budget: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, n_tokens``: the longest prefix of each text within the budget, counted by itself.

    Null texts come back empty.  The counts stay in the task that made them.
    """
    def make():
        c = counter(path)

        def f(doc, text):
            counts = c.counts(text or "")
            k = fitting(counts, budget)
            yield doc, (text or "")[:k], int(counts[k])
        return f

    return map_rows(_texts(docs, id_col, text_col), make, "doc_id bigint, text string, n_tokens bigint", rows=64)
