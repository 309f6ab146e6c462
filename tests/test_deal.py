"""Queries with several steps over the same keys count their rows once and move them in partitions of a bounded number of rows."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from obsflow.plans import ordered as o

QUERIES = ["merge_rest_runs", "printed_rows", "printed_slots", "write_projects", "write_projects_files", "bar_issues", "verify_numbering_widths",
           "fill_boundaries", "complete_unit_count", "row_width_fraction"]


@pytest.mark.parametrize("name", QUERIES)
def test_rows_are_counted_once_and_every_shuffle_is_dealt(spark, monkeypatch, name):
    calls = []
    sizes = o._sizes
    monkeypatch.setattr(o, "_sizes", lambda df, keys: calls.append(keys) or sizes(df, keys))
    conf = {"spark.obsflow.task.rows": "100", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        plan = entry.queries()[name](spark, entry.SMOKE)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k in conf:
            spark.conf.unset(k)
    assert len(calls) == 1
    # Spark's own shuffles have a fixed number of partitions, so their tasks grow with the input.
    assert not [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "ENSURE_REQUIREMENTS" in x]


def test_score_issues_reads_lines_once_after_they_are_counted(spark):
    conf = {"spark.obsflow.task.rows": "100", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "1000"}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        plan = entry.queries()["score_issues"](spark, entry.SMOKE)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k in conf:
            spark.conf.unset(k)
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert plan.count("FileScan parquet") == 2 and "ENSURE_REQUIREMENTS" not in plan


def test_score_issues_deals_many_rows_without_a_sort_by_the_tasks_that_read_them(spark):
    want = sorted(entry.queries()["score_issues"](spark, entry.SMOKE).collect(), key=str)
    # Rows for 240 partitions: Spark writes to 200 files without sorting, but not to more.
    conf = {"spark.obsflow.task.rows": "25", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        df = entry.queries()["score_issues"](spark, entry.SMOKE)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert re.findall(r"hashpartitioning\(k#\w+, (\d+)\), REPARTITION_BY_NUM", plan) == ["200", "200"]
        assert sorted(df.collect(), key=str) == want
        # A quarter more rows a task, and no more than that.
        assert [o._parts(spark, 25 * n) for n in (1, 2, 200, 201, 250, 251, 1000)] == [0, 4, 200, 200, 200, 251, 1000]
    finally:
        for k in conf:
            spark.conf.unset(k)


def test_only_groups_with_many_rows_are_counted_by_key(spark, monkeypatch):
    d = spark.range(20000).select(F.when(F.col("id") < 300, -1).otherwise(F.col("id")).alias("k"))
    seen, group = [], type(d).groupBy
    monkeypatch.setattr(type(d), "groupBy", lambda df, *by: (seen.append(df.count()) if by and isinstance(by[0], str) else None) or group(df, *by))
    spark.conf.set("spark.obsflow.group.rows", "100")
    try:
        assert o._sizes(d, ["k"]) == (300, 20000)
        assert len(seen) == 1 and 300 <= seen[0] < 400
        assert o._sizes(d.filter("k >= 0"), ["k"])[1] == 19700 and len(seen) == 1
        assert o._sizes(d.filter("k < -1"), ["k"]) == (0, 0) and o._sizes(d, []) == (20000, 20000)
    finally:
        spark.conf.unset("spark.obsflow.group.rows")
