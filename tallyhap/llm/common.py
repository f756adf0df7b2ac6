"""Helpers shared by the operators: the shared folder and written tables."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where the session names none and runs in one process (tests), a temporary
    folder is set; on a cluster without the setting this raises ValueError.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="shared-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_steps: list[list[str]] = []


@contextmanager
def steps(spark: SparkSession) -> Iterator[None]:
    """Tables written within are deleted at the end, but those to be kept."""
    _steps.append([])
    try:
        yield
    finally:
        for path in _steps.pop():
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """df written once to the shared folder and reread, so that a lost executor
    does not make Spark run its lineage again (and Python state differ). keep:
    beyond the `steps` that it is written in."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    if _steps and not keep:
        _steps[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(df: DataFrame, order: list, name: str, table: str) -> DataFrame:
    """df with a column `name` that counts its rows from 0 in the given order:
    ranges are sorted each by its own task, and their sizes give the offsets."""
    spark, part, key = df.sparkSession, temp_column(df, "part"), [temp_column(df, f"order{k}") for k in range(len(order))]
    keyed = df.select("*", *(c.alias(k) for c, k in zip(order, key)))
    ranged = written(keyed.repartitionByRange(partitions(spark), *key).withColumn(part, F.spark_partition_id()), table)
    sizes = sorted((r[0], r[1]) for r in ranged.groupBy(part).count().collect())  # one row a partition
    before, offsets = 0, []
    for k, n in sizes:
        offsets.append((k, before))
        before += n
    at = F.element_at(F.create_map(*(F.lit(x) for kv in offsets for x in kv)), F.col(part)) if offsets else F.lit(0)
    place = F.row_number().over(Window.partitionBy(part).orderBy(*key)) - 1 + at
    return ranged.withColumn(name, place.cast("long")).drop(part, *key)


def temp_column(df: DataFrame, stem: str) -> str:
    """A column name that df does not have (names compare without case)."""
    have = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name.lower() in have:
        name += "_"
    return name


def small_batches(spark: SparkSession) -> None:
    """Texts may be long, so few rows go to Python at once, unless the session
    asks for a number of its own."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, "1000")


def release_memory() -> None:
    """At a task's end: give freed memory back, as idle workers live on."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
