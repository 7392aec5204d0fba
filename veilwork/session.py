"""Session building and the shared folder that jobs may write intermediate tables to."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
_local: dict[str, str] = {}
_made: dict[str, list[str]] = {}


def build_session(app: str = "veilwork", cpus: int | None = None, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    cores = cpus or os.cpu_count() or 8
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: the one the cluster names in spark.checkpoint.dir.

    A machine-local folder is only ever chosen for a local master, once per application.
    """
    context = spark.sparkContext
    named = spark.conf.get(CHECKPOINT_CONF, None) or context.getConf().get(CHECKPOINT_CONF)
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    if context.applicationId not in _local:
        _local[context.applicationId] = tempfile.mkdtemp(prefix="veilwork-")
    return _local[context.applicationId]


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new, not yet existing path below the shared folder."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table on whatever file system it lies."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def clean_up(spark: SparkSession) -> int:
    """Delete all intermediate tables of this application that still exist, and return how many paths were tried.

    Call it when no frame that an operator returned is read any more: they read these tables.
    """
    paths = _made.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        remove(spark, path)
    return len(paths)


def at_once(spark: SparkSession, steps: Sequence[Callable[[], object]], most: int | None = None) -> list:
    """What each of some independent steps returns; their jobs run side by side, `most` at a time, a thread of the driver for each."""
    if not steps:
        return []
    with ThreadPoolExecutor(min(len(steps), most or len(steps))) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(s)) for s in steps]]


class Scratch:
    """Intermediate tables of one job, dropped as soon as no later step reads them.

    Written tables survive lost executors, which cached blocks do not. What the returned frame
    still reads stays; everything else goes with drop().
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.label, self.paths = spark, label, {}

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = fresh_dir(self.spark, f"{self.label}-{name}")
        df.write.parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            remove(self.spark, self.paths.pop(name))


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a frame that several branches read and read it back.

    The written table survives executor loss, which cached blocks do not.
    """
    path = fresh_dir(df.sparkSession, label)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
