"""Table functions for SQL users."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


class ExplodeWindows:
    """Batches of ``size`` with ``overlap`` that item ``i`` (from 0) of ``n`` belongs to."""

    def eval(self, i: int, n: int, size: int, overlap: int):
        stride = size - overlap
        last = max(0, -(-(n - overlap) // stride) - 1)
        for b in range(max(0, (i - size) // stride + 1), min(last, i // stride) + 1):
            yield b, i - b * stride


def register(spark: SparkSession) -> None:
    """Make ``explode_windows(i, n, size, overlap)`` available to SQL."""
    spark.udtf.register("explode_windows", udtf(ExplodeWindows, returnType="batch bigint, pos bigint"))
