"""Ranks and running totals that never sort one whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def hash_order(seed: str | int, *ids: Column) -> Column:
    """A reproducible pseudo-random order key: 32 hex digits."""
    parts = [F.lit(str(seed))] + [i.cast("string") for i in ids]
    return F.md5(F.concat_ws("|", *parts))


def hash_bucket(key: Column, digits: int = 4) -> Column:
    """Leading digits of a hash key; monotone in the key."""
    return F.substring(key, 1, digits)


def hash_unit(key: Column) -> Column:
    """A hash key as a number in [0, 1)."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def running_rank(df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column,
                 out: str = "rank") -> DataFrame:
    """1-based rank of each row within its key group; null keys are a group like any other.

    `bucket` must not decrease along `order` (null comes first, as Spark sorts it). Rows are
    ranked inside (keys, bucket) only and shifted by the sizes of the earlier buckets, so a key
    that holds a third of all rows is still spread over as many tasks as it has buckets.
    """
    # Keys and bucket as one struct: structs are equal where their nulls are, so no row is lost.
    cell = F.struct(F.struct(F.lit(0).alias("_"), *keys).alias("group"), bucket.alias("bucket"))
    celled = df.withColumn("_cell", cell)
    sizes = celled.groupBy("_cell").agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.partitionBy("_cell.group").orderBy("_cell.bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("_cell", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_shift"))
    inner = Window.partitionBy("_cell").orderBy(*order)
    ranked = celled.withColumn("_inner", F.row_number().over(inner))
    joined = ranked.join(shifts, "_cell")
    return joined.withColumn(out, F.col("_shift") + F.col("_inner")).drop("_cell", "_size", "_shift", "_inner")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
                  out: str = "rank") -> DataFrame:
    """The first n rows of every key group, ranked.

    Spark trims each input partition to n rows per key before the shuffle, so the size of a
    group does not matter.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(window)).filter(F.col(out) <= n)
