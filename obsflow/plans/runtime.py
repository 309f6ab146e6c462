"""Session settings that operators consult: sizes, checkpoints, guarded broadcasts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A key with more rows than this is processed in several chunks.
GROUP_ROWS = "spark.obsflow.group.rows"
GROUP_ROWS_DEFAULT = 4_000_000
# Rows per chunk of a large key; the same number unless set.
CHUNK_ROWS = "spark.obsflow.chunk.rows"
# Rows a task should hold where many small keys are dealt over tasks.
TASK_ROWS = "spark.obsflow.task.rows"
TASK_ROWS_DEFAULT = 1_000_000
# Over at most this many partitions a task writes rows straight to files; over more it sorts all it has read in memory.
DIRECT_PARTS = "spark.shuffle.sort.bypassMergeThreshold"
DIRECT_PARTS_DEFAULT = 200
# A side with at most this many rows may be broadcast.
BROADCAST_ROWS = "spark.obsflow.broadcast.rows"
BROADCAST_ROWS_DEFAULT = 200_000


def setting(spark: SparkSession, name: str, default: int) -> int:
    return int(spark.conf.get(name, str(default)))


def group_rows(spark: SparkSession) -> int:
    return setting(spark, GROUP_ROWS, GROUP_ROWS_DEFAULT)


def chunk_rows(spark: SparkSession) -> int:
    return setting(spark, CHUNK_ROWS, group_rows(spark))


def task_rows(spark: SparkSession) -> int:
    return setting(spark, TASK_ROWS, TASK_ROWS_DEFAULT)


def direct_parts(spark: SparkSession) -> int:
    return setting(spark, DIRECT_PARTS, DIRECT_PARTS_DEFAULT)


# Plan nodes that keep or lower the number of rows.
_NO_MORE = frozenset("Project Filter Aggregate Distinct Deduplicate Sort Window SubqueryAlias View RepartitionByExpression Repartition GlobalLimit LocalLimit Sample Relation LogicalRelation".split())


def _nodes(plan):
    yield plan.nodeName()
    kids = plan.children()
    for i in range(kids.size()):
        yield from _nodes(kids.apply(i))


def file_rows(df: DataFrame) -> int | None:
    """An upper bound of the rows of a frame from the footers of the parquet files it reads.

    None where a step could add rows (a join, a union, a generator, a function over
    partitions) or another source is read.
    """
    if not all(n.split(" ")[0] in _NO_MORE for n in _nodes(df._jdf.queryExecution().analyzed())):
        return None
    files = sorted(df.inputFiles())
    if not files or not all(f.endswith(".parquet") for f in files):
        return None
    return df.sparkSession.read.parquet(*files).count()


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's shared checkpoint folder; a temporary one only in local mode, where the driver does all the work."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
                raise RuntimeError("set spark.checkpoint.dir to a shared folder")
            shared = tempfile.mkdtemp(prefix="obsflow-")
        sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the session's reliable checkpoint folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def work_folder(spark: SparkSession) -> str:
    """A new folder below the checkpoint folder, for streams and written tables."""
    return f"{checkpoint_folder(spark)}/{uuid.uuid4().hex}"


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Mark ``df`` for broadcast only when a count shows it is within the bound.

    Above the bound the frame is returned unchanged, so the join is planned as a
    shuffle join (which adaptive execution splits where a key is skewed).
    """
    bound = rows or setting(df.sparkSession, BROADCAST_ROWS, BROADCAST_ROWS_DEFAULT)
    if df.count() <= bound:
        return F.broadcast(df)
    return df
