"""Connected components as alternating star joins over written edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import Scratch


def _symmetric(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each larger neighbour of a vertex to the smallest vertex around it."""
    both = _symmetric(edges)
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link each vertex and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, scratch: Scratch, name: str = "component") -> DataFrame:
    """(id, root): for each vertex that has a link, the smallest vertex reachable from it.

    `edges` holds two columns of ids; direction, repetition, loops and nulls do not matter.
    Minima are combined before they move, so a hub of a third of all links is one row per
    task; the joins that follow may be split. Two joins per round, and the number of rounds
    grows with the logarithm of the longest chain. Nothing comes to the driver but a count and
    a checksum per round.
    """
    first, second = edges.columns[:2]
    current = edges.select(F.col(first).alias("a"), F.col(second).alias("b")).filter("a <> b")
    current = scratch.table(current.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    tables, state, step = [f"{name}-0"], None, 0
    while True:
        seen = current.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if seen[0] == 0 or tuple(seen) == state:
            break
        state, step = tuple(seen), step + 1
        current = scratch.table(_small_star(_large_star(current)).filter("a <> b").distinct(), f"{name}-{step}")
        scratch.drop(tables.pop())
        tables.append(f"{name}-{step}")
    roots = current.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("root"))
    return roots.unionByName(current.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
