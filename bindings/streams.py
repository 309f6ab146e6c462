"""Stand-in inputs built from the driver's tables, and the same inputs as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindings import table
from obsflow.functions.exprs import seconds
from obsflow.plans.ordered import Ordered, row_number

EV = "ev AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, event_type, value, ts FROM events)"
EVN = EV + """, evn AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS rn,
 count(*) OVER (PARTITION BY user_id) AS n FROM ev)"""
LI = """li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS seq
 FROM lineitem)"""
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey"]


def ev(spark, sf) -> DataFrame:
    """Events as samples: stream user_id, order (t, event_id)."""
    e = table(spark, sf, "events")
    return e.select("user_id", "event_id", seconds("ts").alias("t"), "event_type", "value", "ts")


def pages_of(spark, sf, size: int) -> DataFrame:
    """Pages of ``size`` consecutive event types per user."""
    o = Ordered(ev(spark, sf), ["user_id"], ["t", "event_id"]).with_columns(rn=row_number())
    d = o.result.withColumn("page", F.floor((F.col("rn") - 1) / size))
    return d.groupBy("user_id", "page").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rn", "event_type"))), lambda x: x["event_type"]).alias("rows"))


def pages_sql(size: int) -> str:
    return EVN + f""", pg AS (SELECT user_id, (rn - 1) // {size} AS page, list(event_type ORDER BY rn) AS rows
 FROM evn GROUP BY ALL)"""


def lines(spark, sf) -> DataFrame:
    """Line items as the ordered lines of a project (the order)."""
    return table(spark, sf, "lineitem")
