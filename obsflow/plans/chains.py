"""Following references to their end in a logarithmic number of joins."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsflow.plans import runtime


def resolve_chains(links: DataFrame, keys: list[str], node: str, target: str) -> DataFrame:
    """Last node reached from each linked node, and how many links lead there.

    ``links`` has at most one row per (keys, node).  Every round doubles the distance a
    link covers.  A node on or leading into a circle has no end; it is left with
    ``circular`` true.  Rounds are cut with checkpoints, and stop after log2(links).
    """
    cur = runtime.checkpoint(links.select(*keys, F.col(node).alias("node"), F.col(target).alias("end"), F.lit(1).cast("bigint").alias("steps")))
    rounds = math.ceil(math.log2(max(cur.count(), 1) + 1)) + 1
    open_ = True
    for _ in range(rounds):
        nxt = cur.select(*keys, F.col("node").alias("end"), F.col("end").alias("_e"), F.col("steps").alias("_s"))
        hop = cur.join(nxt, [*keys, "end"], "left")
        cur = runtime.checkpoint(hop.select(
            *keys, "node", F.coalesce("_e", "end").alias("end"), (F.col("steps") + F.coalesce("_s", F.lit(0))).alias("steps"),
            F.col("_e").isNotNull().alias("_moved")))
        open_ = not cur.filter("_moved").isEmpty()
        cur = cur.drop("_moved")
        if not open_:
            break
    if not open_:
        return cur.withColumn("circular", F.lit(False))
    still = links.select(*keys, F.col(node).alias("end")).distinct().withColumn("circular", F.lit(True))
    return cur.join(still, [*keys, "end"], "left").withColumn("circular", F.coalesce("circular", F.lit(False)))
