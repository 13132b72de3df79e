"""Session helpers: reading tables and cutting lineage durably."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

from .model import HOME

T = TypeVar("T")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session's context. It is the one named by ``spark.checkpoint.dir``; only in local mode,
    and where neither that setting nor a folder set on the context exists, a temporary one is chosen. On a cluster a
    missing folder is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all machines of the cluster share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tessera-checkpoint-"))
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back, so later jobs survive lost executors."""
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


_STORED: list[tuple[SparkSession, str]] = []


def stored(df: DataFrame) -> DataFrame:
    """Writes df as a Parquet table into the shared folder and reads it back: as durable() does, but later reads take the
    columns and rows that they need alone, and it is compressed. The table is deleted when Python ends."""
    spark = df.sparkSession
    folder = scratch(spark, "table")
    if not _STORED:
        atexit.register(_drop_stored)
    _STORED.append((spark, folder))
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def kept(df: DataFrame) -> DataFrame:
    """stored(), unless df has HOME: what comes spread is made again where it is, which takes no room."""
    return df if HOME in df.columns else stored(df)


def _drop_stored() -> None:
    for spark, folder in _STORED:
        try:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001 - the session may have ended; its folder is the cluster's to clean
            shutil.rmtree(folder.removeprefix("file:"), ignore_errors=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's name below the shared one."""
    return f"{_shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def colocated(df: DataFrame, key: str) -> DataFrame:
    """df spread by key. Aggregates, windows and joins whose keys include it then need no shuffle of their own; joins only
    if Spark doesn't ask for all of their keys to be spread by. A task gets about a megabyte of the input, as it has all
    that is made of that too. What is made there takes long code; Java doesn't compile methods of more than 8000 bytes, and
    Spark is told to take shorter ones instead."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(max(shuffle_width(spark), min(size >> 20, 10_000)), key)


def asked(df: DataFrame, ask: Callable[[DataFrame], T]) -> T:
    """What ask finds out by a job on df before the query's own one. The job's shuffle files, which else stay until the driver
    collects its garbage, are deleted as it ends."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key)
    conf.set(key, "true")
    try:
        return ask(df)
    finally:
        conf.set(key, before)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
