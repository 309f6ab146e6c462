import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    s = (SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(params=["small keys", "large keys"])
def sized(spark, request):
    """The session with keys treated as small, then as large (several chunks per key)."""
    if request.param == "large keys":
        spark.conf.set("spark.obsflow.group.rows", "1")
        spark.conf.set("spark.obsflow.chunk.rows", "4")
    yield spark
    spark.conf.unset("spark.obsflow.group.rows")
    spark.conf.unset("spark.obsflow.chunk.rows")


def rows(df, *cols, order=None):
    d = df.select(*cols) if cols else df
    return [tuple(r) for r in d.orderBy(*(order or d.columns)).collect()]
