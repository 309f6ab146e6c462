"""Words, word hashes and per-row Arrow mapping shared by the text operators."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Entries after which a worker's cache starts again.
CACHE_WORDS = 200_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def worker_state(kind: str) -> dict:
    """A dictionary that lives as long as the Python process, across the tasks it runs.

    Only the last kind that was asked for is kept, and what the one before it held goes back
    to the system, so that the stages of a job that share workers do not add up.
    """
    holder = sys.modules.setdefault("_obsflow_worker_state", types.ModuleType("_obsflow_worker_state")).__dict__
    if holder.get("kind") != kind:
        holder["kind"], holder["state"] = kind, {}
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)
    return holder["state"]


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def word_list(text: str | None) -> list[bytes]:
    """Maximal runs of characters other than space, tab, LF, VT, FF and CR, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    state = worker_state("words")
    known = state.get("words")
    if known is None:
        known = state["words"] = _WordHashes()
    return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _MIX
    return h ^ (h >> np.uint64(29))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every `width` consecutive words: a polynomial in the word hashes modulo 2**64, by doubling.

    hash(a + b) = hash(a) * BASE**len(b) + hash(b), so a window of any width is put
    together from windows whose widths are powers of two.
    """
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out, done = None, 0
    power, span, scale = hashes, 1, _BASE
    rest = width
    with np.errstate(over="ignore"):
        while True:
            if rest & 1:
                out = power[:n].copy() if out is None else out * scale + power[done:done + n]
                done += span
            rest >>= 1
            if not rest:
                return mixed(out)
            power = power[:len(power) - span] * scale + power[span:]
            span, scale = span * 2, scale * scale


def map_rows(df: DataFrame, make: Callable[[], Callable[..., Iterator[tuple]]], schema: str | T.StructType, rows: int = 512) -> DataFrame:
    """Map each row of ``df`` (values in column order) to tuples of ``schema``, in Arrow batches."""
    struct = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    arrow = to_arrow_schema(struct)

    def run(batches):
        f = make()
        out: list[tuple] = []
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    out.extend(f(*row))
                    if len(out) >= rows:
                        yield _batch(out, arrow)
                        out = []
        if out:
            yield _batch(out, arrow)

    return df.mapInArrow(run, struct)


def _batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)


def map_arrays(df: DataFrame, make: Callable[[], Callable[..., tuple | None]], schema: str, flush: int = 100_000) -> DataFrame:
    """Like ``map_rows`` for functions that return equally long numpy arrays, one for each column."""
    struct = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(struct)

    def run(batches):
        f = make()
        held: list[tuple] = []
        count = 0

        def emit():
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), type=t.type) for c, t in zip(zip(*held, strict=True), arrow, strict=True)], schema=arrow)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for row in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                    got = f(*row)
                    if got is not None and len(got[0]):
                        held.append(got)
                        count += len(got[0])
                        if count >= flush:
                            yield emit()
                            held, count = [], 0
        if held:
            yield emit()

    return df.mapInArrow(run, struct)
