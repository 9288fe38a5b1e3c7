"""Session helpers: the cluster's shared folder and tables cut from their lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_SCOPES: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, else the session's checkpoint folder.

    Only a session on one machine (tests) may have neither; it gets a temporary
    folder that is deleted when Python ends.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        local = tempfile.mkdtemp(prefix="lodeseek-")
        atexit.register(shutil.rmtree, local, True)
        folder = "file://" + local
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete every intermediate table written inside when the block ends; results must be written or collected by then."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, where it is not installed there."""
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="lodeseek-")
    atexit.register(shutil.rmtree, folder, True)
    archive = shutil.make_archive(os.path.join(folder, "lodeseek"), "zip", os.path.dirname(package), os.path.basename(package))
    spark.sparkContext.addPyFile(archive)


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Later stages then restart from files that survive the loss of an executor,
    and a plan that uses the table twice computes it once. ``scratch`` deletes them.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    writer = df.write.mode("error")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(_nullable(df, partition_by)).parquet(path)


def _nullable(df: DataFrame, partition_by: list[str] | None) -> T.StructType:
    last = partition_by or []
    fields = [f for f in df.schema.fields if f.name not in last] + [f for f in df.schema.fields if f.name in last]
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in fields])


def shuffle_partitions(spark: SparkSession) -> int:
    """Partitions of a shuffle that feeds work in Python: a number given is kept, where adaptive execution would coalesce by bytes."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores.

    A small table comes in one or two files, and work in Python on its rows
    would hold a single core; a large one has enough partitions and is left as
    it is. Only the number of partitions differs, never a row.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
