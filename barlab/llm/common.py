"""Shared small helpers: reading tables, word sizes, shared scratch tables."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java pattern of one run of the six ASCII white-space characters.
BLANKS = r"[\x20\x09-\x0D]+"
#: What this Python worker keeps for its next tasks, under the name of its use.
_kept: dict[Any, Any] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the given tables; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Number of maximal runs of characters other than ASCII white space; null counts 0."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), rf"^{BLANKS}|{BLANKS}$", "")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, BLANKS))).cast("long")


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir).

    Where the setting is absent, a temporary folder is made and set once for the session; only in
    local mode (tests, notebooks), as on a cluster executors would not see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/barlab-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, lost executors
    cost nothing upstream, and later readers take only the columns they need."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Intermediate:
    """Stored tables that one call needs for a while; clear() deletes them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def stored(self, df: DataFrame) -> DataFrame:
        path = scratch(self.spark)
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        for path in self.paths:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
        self.paths = []


def remembered(name: Any, make: Callable[[], Any]) -> Any:
    """What make() gives, kept by the Python worker for its next tasks of the same name.

    A worker serves one operator after another; it keeps one name at a time, so that the
    memories of different operators never add up.
    """
    if name not in _kept:
        forget()
        _kept[name] = make()
    return _kept[name]


def forget() -> None:
    """Drop what this Python worker keeps from other operators' tasks."""
    if _kept:
        _kept.clear()
        give_back()


def give_back() -> None:
    """Return this Python worker's free memory to the machine, which its executor shares."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)
