"""The two physical forms of ordered computation agree, also when one key is very large."""

import random
import sys

import pytest
from conftest import rows
from pyspark import cloudpickle
from pyspark.sql import functions as F

from obsflow.plans import ordered as o
from obsflow.plans import ranges, runtime
from obsflow.plans.chains import resolve_chains

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def skewed(spark, n=400):
    """A third of all rows has one key; keys may be null."""
    rnd = random.Random(1)
    data = [(rnd.choice(["hot", "hot", "hot", "hot", None, *[f"k{i}" for i in range(6)]]), i, rnd.choice([None, rnd.randint(0, 9)])) for i in range(n)]
    return spark.createDataFrame(data, "k string, i int, v int").repartition(5)


OPS = {
    "rn": lambda: o.row_number(), "lag1": lambda: o.lag("v"), "lag3": lambda: o.lag("i", 3), "lead2": lambda: o.lead("i", 2),
    "sum": lambda: o.running_sum("v"), "sum_before": lambda: o.running_sum("v", inclusive=False), "max": lambda: o.running_max("v"),
    "min": lambda: o.running_min("v", inclusive=False), "known": lambda: o.last_known("v"), "known_before": lambda: o.last_known("v", inclusive=False),
    "next": lambda: o.next_known("v"), "next_after": lambda: o.next_known("v", inclusive=False), "n": lambda: o.count_all(), "top": lambda: o.total(F.max, "v"),
    "before": lambda: o.before("v", 4), "after": lambda: o.after("i", 3),
}


def test_windows_agree(spark):
    d = skewed(spark)
    small = rows(o.Ordered(d, ["k"], ["i"]).with_columns(**{n: f() for n, f in OPS.items()}).result, order=["i"])
    spark.conf.set("spark.obsflow.group.rows", "30")
    try:
        big = o.Ordered(d, ["k"], ["i"])
        assert big.chunked
        # No chunk holds more than its share although one key holds most rows.
        assert big.df.groupBy("_chunk").count().agg(F.max("count")).first()[0] <= 90
        large = rows(big.with_columns(**{n: f() for n, f in OPS.items()}).result, order=["i"])
    finally:
        spark.conf.unset("spark.obsflow.group.rows")
    assert small == large


class Runs(o.Fold):
    schema = "run bigint, first int, n int"
    counters = 1

    def step(self, core, acc, row, emit):
        i, v = row
        if core is not None and core[1] == v:
            return (core[0], v, core[2] + 1)
        self.finish(core, acc, emit)
        return (i, v, 1)

    def finish(self, core, acc, emit):
        if core is not None:
            acc[0] += 1
            emit(acc[0], core[0], core[2])


@pytest.mark.parametrize("values", [lambda r: r.randint(0, 1), lambda r: 1, lambda r: r.randint(0, 99)])
def test_folds_agree(spark, values):
    rnd = random.Random(5)
    d = spark.createDataFrame([(rnd.choice(["hot", "hot", "x", "y"]), i, values(rnd)) for i in range(300)], "k string, i int, v int").repartition(4)
    small = rows(o.Ordered(d, ["k"], ["i"]).fold(Runs(), ["i", "v"]))
    spark.conf.set("spark.obsflow.group.rows", "25")
    try:
        large = rows(o.Ordered(d, ["k"], ["i"]).fold(Runs(), ["i", "v"]))
    finally:
        spark.conf.unset("spark.obsflow.group.rows")
    assert small == large


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_folds_after_windows_agree(spark, adaptive):
    """Windows shuffle rows by chunk; here there are more chunks than shuffle partitions."""
    rnd = random.Random(7)
    d = spark.createDataFrame([(rnd.choice(["hot", "hot", "hot", "x", None]), i, rnd.randint(0, 2)) for i in range(1000)], "k string, i int, v int").repartition(4)

    def run():
        x = o.Ordered(d, ["k"], ["i"]).with_columns(rn=o.row_number(), was=o.lag("v"))
        return rows(x.where(F.col("rn") % 7 != 3).fold(Runs(), ["rn", "v"]))

    small = run()
    conf = {"spark.obsflow.group.rows": "1", "spark.obsflow.chunk.rows": "30", "spark.sql.adaptive.enabled": adaptive, "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        large = run()
    finally:
        for k in conf:
            spark.conf.unset(k)
    assert small == large


def test_size_of_an_exploded_input_is_counted(spark, tmp_path):
    spark.createDataFrame([("a b c " * 50,), ("d",)], "t string").coalesce(1).write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    words = t.select(F.posexplode(F.split("t", " ")).alias("i", "w")).withColumn("k", F.lit("hot"))
    assert runtime.file_rows(t.filter("t <> ''")) == 2 and runtime.file_rows(words) is None
    spark.conf.set("spark.obsflow.group.rows", "20")
    try:
        assert o.Ordered(words, ["k"], ["i", "w"]).chunked
        assert not o.Ordered(t.withColumn("k", F.lit(1)), ["k"], ["t"]).chunked
    finally:
        spark.conf.unset("spark.obsflow.group.rows")


def test_exact_median(sized):
    d = sized.createDataFrame([("a", 1.0, 1), ("a", 9.0, 2), ("a", 3.0, 3), ("a", 4.0, 4), ("b", 5.0, 5)], "k string, v double, i int")
    assert rows(o.exact_median(d, ["k"], "v", "m", ["i"])) == [("a", 3.5), ("b", 5.0)]


def test_best_keeps_the_first_of_equals(spark):
    d = spark.createDataFrame([("a", 2, 1, "x"), ("a", 1, 3, "y"), ("a", 1, 2, "z")], "k string, score int, pos int, v string")
    assert rows(o.best(d, ["k"], ["score", "pos"]), "v") == [("z",)]


def test_chains(spark):
    d = spark.createDataFrame([("p", i, i - 1) for i in range(1, 40)] + [("p", 50, 51), ("p", 51, 50), ("p", 60, 50)], "k string, a int, b int")
    got = {r[1]: (r[0], r[2]) for r in rows(resolve_chains(d, ["k"], "a", "b").select("end", "node", "circular"))}
    assert got[39] == (0, False) and got[1] == (0, False) and all(got[n][1] for n in (50, 51, 60))


def test_broadcast_only_below_the_bound(spark):
    small = runtime.small(spark.range(10), 10)
    assert small.count() == 10
    big = spark.range(11)
    assert runtime.small(big, 10) is big


def test_checkpoint_folder_comes_from_the_session(spark):
    folder = runtime.work_folder(spark)
    assert folder.startswith(spark.sparkContext.getCheckpointDir())


def test_intervals_that_meet(spark):
    rnd = random.Random(6)
    left = [("ab"[i % 2], i, x := rnd.uniform(-50, 50), x + rnd.choice([0, 0, 1, 5, 60])) for i in range(60)] + [("a", 90, 5.0, 4.0)]
    right = [("ab"[i % 2], i, x := rnd.uniform(-50, 50), x + rnd.choice([0, 2, 3, 90])) for i in range(60)] + [("a", 91, -1e6, 1e6), ("a", 92, 3.0, 1.0)]
    a, b = spark.createDataFrame(left, "k string, i int, x double, y double"), spark.createDataFrame(right, "k string, j int, u double, v double")
    want = sorted((l[0], l[1], r[1]) for l in left for r in right if l[0] == r[0] and l[2] <= r[3] and r[2] <= l[3] and l[2] <= l[3] and r[2] <= r[3])
    for cell in (0.5, 4.0, 1000.0):
        pairs = ranges.cell_join(a, b, ["k"], F.col("x"), F.col("y"), F.col("u"), F.col("v"), cell)
        assert rows(pairs, "k", "i", "j") == want
    # An interval over everything becomes tens of rows.
    span = spark.range(1).select(F.lit(0).cast("bigint").alias("f"), F.lit(10**9).cast("bigint").alias("l"))
    assert ranges._places(span, "_k", "_i", F.col("f"), F.col("l"), F.lit(30), 1).count() < 100


def test_rows_of_a_task_are_bounded(spark):
    d = spark.range(4000).selectExpr("id % 500 as k", "id as i", "1 as v").withColumn("v", F.col("v") + 0)
    plain = rows(o.Ordered(d, ["k"], ["i"]).with_columns(s=o.running_sum("v"), p=o.lag("i")).result)
    spark.conf.set("spark.obsflow.task.rows", "500")
    spark.conf.set("spark.obsflow.group.rows", "3000")
    try:
        out = o.Ordered(d, ["k"], ["i"]).with_columns(s=o.running_sum("v"), p=o.lag("i")).result
        # Adaptive execution would merge these few rows into one partition.
        per = [n for n, in out.groupBy(F.spark_partition_id().alias("p")).count().select("count").collect()]
        assert len(per) == 8 and sum(per) == 4000 and max(per) < 1000
        assert rows(out) == plain
    finally:
        spark.conf.unset("spark.obsflow.task.rows")
        spark.conf.unset("spark.obsflow.group.rows")
