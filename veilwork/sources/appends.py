"""Appends that count once: rows are staged under a batch's name and published by one small file.

A table is a folder of staged attempts and a folder of manifests. An attempt's rows are written
first; then a manifest that names the attempt is put in place by one rename. Readers read what
manifests name, so a job that is repeated leaves its rows once, and one that dies half-way leaves
nothing to be read. Rows are laid out by day, so reads can skip days.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Tasks, and so files, that one day of an append is dealt to.
FILES_PER_DAY = 8


def _files(spark: SparkSession, path: str):
    """(file system, path) as Hadoop's classes, on whatever store the path lies."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def published(spark: SparkSession, path: str) -> dict[str, str]:
    """Batch -> attempt, from the manifests. One small file per batch."""
    system, folder = _files(spark, f"{path}/published")
    if not system.exists(folder):
        return {}
    names = [s.getPath().getName() for s in system.listStatus(folder)]
    # A manifest's name says all: the batch, and the attempt that counts.
    return dict(n.rsplit("@", 1) for n in names if "@" in n and not n.startswith((".", "_")))


def _publish(spark: SparkSession, path: str, batch: str, attempt: str) -> bool:
    """Put the manifest in place; False if the batch has one by now.

    The appends of one batch come one after another (retries, or a stream's micro-batch), so
    nothing stands between the look and the rename.
    """
    system, folder = _files(spark, f"{path}/published")
    system.mkdirs(folder)
    if batch in published(spark, path):
        return False
    made, named = (_files(spark, f"{path}/published/{name}")[1] for name in (f".{batch}@{attempt}", f"{batch}@{attempt}"))
    system.create(made, True).close()
    return bool(system.rename(made, named))


def append_once(df: DataFrame, path: str, batch: str, time_col: str | None = "created_at") -> bool:
    """Append the rows under the batch's name; False, and nothing added, if the batch is already there.

    With `time_col` the rows are placed by day and a salt first: a day gets FILES_PER_DAY files at
    most, and a day that holds most rows is still several tasks.
    """
    spark = df.sparkSession
    if not batch or any(c in batch for c in "@/\\") or batch.startswith((".", "_")):
        raise ValueError(f"not a name for a batch: {batch!r}")
    if batch in published(spark, path):
        return False
    attempt = uuid.uuid4().hex
    target = f"{path}/data/attempt={attempt}"
    if time_col is None:
        df.write.parquet(target)
    else:
        salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns if df.schema[c].dataType.typeName() != "map"]), F.lit(FILES_PER_DAY))
        dated = df.withColumn("day", F.to_date(time_col))
        dated.repartition(F.col("day"), salt).write.partitionBy("day").parquet(target)
    return _publish(spark, path, batch, attempt)


def read_appended(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all published batches. `schema` is that of the rows, with `day DATE` last if they lie by day."""
    attempts = [f"{path}/data/attempt={a}" for a in sorted(published(spark, path).values())]
    if not attempts:
        return spark.createDataFrame([], schema)
    return spark.read.schema(f"{schema}, attempt STRING").option("basePath", f"{path}/data").parquet(*attempts).drop("attempt")


def drop_unpublished(spark: SparkSession, path: str) -> int:
    """Delete what attempts left that no manifest names; only while no append runs. Returns their number."""
    system, folder = _files(spark, f"{path}/data")
    kept, gone = {f"attempt={a}" for a in published(spark, path).values()}, 0
    for found in system.listStatus(folder) if system.exists(folder) else []:
        if found.getPath().getName() not in kept:
            gone += bool(system.delete(found.getPath(), True))
    return gone


def append_stream(stream: DataFrame, path: str, state: str, label: str, time_col: str | None = None) -> None:
    """Append all there is of a stream, each micro-batch under its own name; repeated ones count once."""
    def write(rows: DataFrame, batch_id: int) -> None:
        append_once(rows, path, f"{label}-{batch_id}", time_col)

    stream.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
