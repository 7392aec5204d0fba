"""Token counts of flat, unindexed token files by a separator scan.

A token file is nothing but little-endian ids end to end, a separator after each document.
Files are cut into blocks; each block is searched for the separator as one vector comparison.
Documents that cross blocks are stitched by a prefix scan over one small row per block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import Scratch
from .tokens import tokenised

BLOCK = 4 << 20
SEPARATOR = 0


def _encode(path: str):
    """(text) -> ids plus 1 as 16-bit numbers; 0 is left for the separator."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, i, j, ids, bounds in tokenised(batches, 0, path, None):
            if len(ids) and ids.max() >= 0xFFFF:
                raise ValueError("an id does not fit 16 bits")
            raw = (ids + 1).astype("<u2").tobytes()
            offsets = pa.array((bounds * 2).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(
                pa.binary(), j - i, [None, offsets.buffers()[1], pa.py_buffer(raw)])], ["ids"])

    return run


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, text: str = "text") -> None:
    """Write the documents as flat files of 16-bit ids: the tokenizer's plus 1, and SEPARATOR.

    Null and empty texts are a separator alone, repeated rows documents of their own; texts are
    whole whatever their length, and ids of any kind are not read. Other columns are ignored,
    whatever their names; an empty table gives files without documents. Spark's line writer does
    the work: a line is a document's ids, the line's end the separator.
    """
    line = SEPARATOR.to_bytes(2, "little").decode("utf-8")
    ids = docs.select(F.col(text).alias("text")).mapInArrow(_encode(tokenizer), "ids binary")
    ids.select(F.col("ids").cast("string").alias("value")).write.option("lineSep", line).text(folder)


def _scan(separator: int, width: int):
    """(path, block, begin, size) -> the same and the token positions of separators in the block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as fs

        for batch in batches:
            for row in batch.to_pylist():
                store, name = fs.FileSystem.from_uri(row["path"])
                with store.open_input_file(name) as file:
                    raw = file.read_at(row["size"], row["begin"])
                ids = np.frombuffer(raw, f"<u{width}")
                ends = np.flatnonzero(ids == separator) + row["begin"] // width
                yield pa.RecordBatch.from_pylist([{"path": row["path"], "block": row["block"], "stop": row["begin"] // width + len(ids),
                                                   "ends": ends}], schema=pa.schema([("path", pa.string()), ("block", pa.int64()),
                                                                                     ("stop", pa.int64()), ("ends", pa.list_(pa.int64()))]))

    return run


def token_counts(spark: SparkSession, folder: str, separator: int = SEPARATOR, width: int = 2, block: int = BLOCK) -> DataFrame:
    """(file, doc_index, start, n_tokens, ended) per document of all token files below `folder`.

    doc_index counts documents within a file, start is the position of the first token. The
    separator is not counted; two in a row enclose an empty document. Tokens after a file's last
    separator are a document that has not ended. An empty file has no documents, an empty folder
    an empty result; bytes at a file's end that are no whole token are left out.

    Files lie where `pyarrow.fs` can reach them (file, hdfs, s3, gs). Blocks are read as ranges,
    so a file of any size is as many tasks as it has blocks.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    whole = F.floor(F.col("length") / width) * width
    blocks = files.filter(whole > 0).select(
        "path", whole.alias("length"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((whole - 1) / block))).alias("block"))
    blocks = blocks.select("path", "block", (F.col("block") * block).alias("begin"),
                           F.least(F.lit(block), F.col("length") - F.col("block") * block).alias("size"))
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = blocks.repartition(tasks, "path", "block").mapInArrow(
        _scan(separator, width), "path string, block long, stop long, ends array<long>")
    found = Scratch(spark, "token-scan").table(found, "ends")
    sums = found.select("path", "block", F.size("ends").alias("n"), F.try_element_at("ends", F.lit(-1)).alias("last"))
    by = Window.partitionBy("path").orderBy("block")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("path", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"),
                       F.coalesce(F.last("last", True).over(before), F.lit(-1)).alias("previous"),
                       F.lead("block").over(by).isNull().alias("closes"))
    stitched = found.join(sums, ["path", "block"])
    ends = F.when(F.col("closes") & (F.coalesce(F.try_element_at("ends", F.lit(-1)), F.col("previous")) < F.col("stop") - 1),
                  F.concat("ends", F.array("stop"))).otherwise(F.col("ends"))
    rows = stitched.withColumn("all", ends).select("path", "base", "previous", "ends", "all", F.posexplode("all").alias("k", "end"))
    start = F.when(F.col("k") == 0, F.col("previous")).otherwise(F.get("all", F.col("k") - 1)) + 1
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("file"), (F.col("base") + F.col("k")).alias("doc_index"),
                       start.alias("start"), (F.col("end") - start).alias("n_tokens"), (F.col("k") < F.size("ends")).alias("ended"))
