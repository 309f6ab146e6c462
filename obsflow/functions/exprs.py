"""Column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(ts: str | Column) -> Column:
    """Microseconds since 1970 of a zone-free timestamp, whatever the session zone."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    whole = F.unix_date(ts.cast("date")).cast("bigint") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    return whole * 1_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")


def seconds(ts: str | Column) -> Column:
    return micros(ts) / F.lit(1e6)


def finite(c: Column) -> Column:
    """True for a number that is neither null, NaN nor infinite."""
    c = c.cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def unfold(arr: str | Column) -> Column:
    """One row per element, and one null row for an empty array.

    A plain explode makes Catalyst test the array's size first, which computes an expensive
    array a second time; callers drop the null rows instead.
    """
    return F.explode_outer(arr)


def joined(arr: Column, sep: str = ",") -> Column:
    return F.array_join(F.transform(arr, lambda x: x.cast("string")), sep)
