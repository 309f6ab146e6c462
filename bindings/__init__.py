"""Queries over the driver's tables, one per operator, with independently written SQL."""

from __future__ import annotations

import importlib
import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# Functions passed to folds travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def load() -> tuple[dict, dict[str, str]]:
    for m in MODULES:
        importlib.import_module(f"bindings.{m}")
    return QUERIES, ORACLES


MODULES = ["sequence", "lookup", "reconcile", "layout", "numbered", "numeric", "sources"]
