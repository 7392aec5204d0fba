"""Named tables on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def scan_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table by name. Columns and filters asked for later reach the Parquet scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ranged(df: DataFrame, *keys: str) -> DataFrame:
    """The table dealt by ranges of its keys, in order within each, in pieces whose number grows with the table.

    A piece is about a quarter of what a task scans; small tables come in as many pieces as Spark
    shuffles anything into, which it may merge.
    """
    pieces = 4 * df.rdd.getNumPartitions()
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(pieces, *keys) if pieces > usual else df.repartitionByRange(*keys)
    return dealt.sortWithinPartitions(*keys)


def spread(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Give every core a share of a scan that comes in far fewer pieces than there are cores.

    Only a table of a few files is shuffled; a large table has more splits than cores and
    stays as it is. With `rows`, a piece has about that many rows at most, whatever the table's
    size: for narrow rows that are costly to work on, of which one split holds millions.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if rows is not None:
        pieces = max(cores, -(-df.count() // rows))
        return df if pieces <= df.rdd.getNumPartitions() else df.repartition(pieces)
    if df.rdd.getNumPartitions() * 2 <= cores:
        return df.repartition(cores)
    return df
