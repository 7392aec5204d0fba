"""Physical lines of text files, numbered exactly however many pieces the files are read in.

Spark reads large files in blocks. Lines are counted per block, the counts are summed up in the
order of files and blocks (one small row per block), and a line's number is its block's sum plus
its place in the block. No line moves, and no file is one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import Scratch

#: Blocks whose sums are broadcast, about 150 bytes each; sums of more blocks are joined by a shuffle.
BROADCAST_BLOCKS = 100_000


def physical_lines(spark: SparkSession, path: str | list[str], name_glob: str | None = None) -> DataFrame:
    """(file, block, length, value): lines in the order in which they are read, ended by newlines only."""
    reader = spark.read.option("lineSep", "\n")
    if name_glob:
        reader = reader.option("pathGlobFilter", name_glob)
    meta = [F.col(f"_metadata.{c}") for c in ("file_path", "file_block_start", "file_block_length")]
    return reader.text(path).select(*[m.alias(n) for m, n in zip(meta, ("file", "block", "length"))], "value")


def unit_of(by: str) -> Column:
    """What is counted through: a file, or all files of a folder in the order of their names."""
    if by not in ("file", "folder"):
        raise ValueError(f"lines are numbered by file or by folder, not by {by}")
    return F.col("file") if by == "file" else F.regexp_replace("file", "/[^/]*$", "")


def sums_before(blocks: DataFrame, count: str, by: str, out: str = "before") -> DataFrame:
    """Adds what earlier blocks of the unit count together. One row per block."""
    earlier = Window.partitionBy(unit_of(by)).orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn(out, F.coalesce(F.sum(count).over(earlier), F.lit(0)))


def join_blocks(df: DataFrame, blocks: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """Per-block figures beside the rows; the block's row travels unless there are too many blocks."""
    return df.join(F.broadcast(blocks) if n <= BROADCAST_BLOCKS else blocks, keys, "left")


def numbered_lines(spark: SparkSession, path: str | list[str], by: str = "file", name_glob: str | None = None) -> DataFrame:
    """(file, line_no, value): each line's number from 0 within its file, or within its folder's files by name.

    Empty lines count, broken ones too. A file that ends in a newline has no empty line after it;
    a carriage return is part of its line. The files are read twice, in the same blocks: were a
    line found outside its block's places, the job would stop instead of numbering it wrongly.
    """
    lines = physical_lines(spark, path, name_glob).withColumn("seq", F.monotonically_increasing_id())
    keys = ["file", "block", "length"]
    blocks = lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"), F.max("seq").alias("last"))
    blocks = Scratch(spark, "line-blocks").table(blocks, "blocks")
    placed = join_blocks(lines, sums_before(blocks, "n", by).drop("n"), blocks.count(), keys)
    number = F.when(F.col("seq").between(F.col("first"), F.col("last")), F.col("before") + F.col("seq") - F.col("first"))
    stop = F.raise_error(F.concat(F.lit("lines were read in other blocks the second time: "), "file")).cast("long")
    return placed.select("file", F.coalesce(number, stop).alias("line_no"), "value")


def first_numbered(lines: DataFrame, n: int) -> DataFrame:
    """The first n physical lines of every file or folder, as numbered."""
    return lines.filter(F.col("line_no") < n)
