"""Exact duplicates by distributed MSD radix partitioning.

Texts are split into groups by a first digit, each group by the bytes that follow, and so on,
until a group has one text or its texts have ended. Digits widen from round to round, so the
number of rounds grows with the logarithm of the longest repeated text. Equality is decided by
the bytes themselves; no digest takes part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import Scratch, fresh_dir, remove

#: Bytes of the first digit, and how much wider each next one is.
FIRST, WIDER = 24, 12
_LAST = (1 << 63) - 1


def normalised(text: Column) -> Column:
    """Null as empty; each run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _split(rows: DataFrame, *digits: str) -> DataFrame:
    """Groups of two or more rows with the same digits: their first row, size and a number.

    Counts are combined before they move, so a group of a third of all rows is one row per task.
    """
    order = F.struct(F.coalesce("id", F.lit(_LAST)).alias("order"), "row", "id")
    groups = rows.groupBy(*digits).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return groups.select(*digits, "first", "n")


def _leave(rows: DataFrame, sha: Column) -> DataFrame:
    """Rows whose group is known: (row, id, keep_id, group_size, kept, text_sha256)."""
    alone = F.col("n").isNull()
    return rows.select(
        "row", "id", F.when(alone, F.col("id")).otherwise(F.col("first.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("first.row"))).alias("kept"), sha.alias("text_sha256"))


def radix_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """(row, id, keep_id, group_size, kept, text_sha256) per row of `docs`.

    `row` names a column that tells rows apart; without it the rows are numbered in scan order.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact-dedup")
    number = F.col(row) if row else F.monotonically_increasing_id()
    source = docs.select(number.alias("row"), F.col(id_col).cast("long").alias("id"),
                         normalised(F.col(text)).cast("binary").alias("bytes"))
    # The length is the zeroth digit: few texts share it together with their first bytes.
    source = source.select("row", "id", "bytes", F.octet_length("bytes").alias("length"),
                           F.substring("bytes", 1, FIRST).alias("digit"))
    heads = scratch.table(source.select("row", "id", "length", "digit", F.sha2("bytes", 256).alias("sha")), "heads")
    groups = scratch.table(_split(heads, "length", "digit").withColumn("group", F.monotonically_increasing_id()), "groups")
    going = (F.col("n") > 1) & (F.col("length") > FIRST)
    out = _leave(heads.join(groups, ["length", "digit"], "left").filter(~F.coalesce(going, F.lit(False))), F.col("sha"))

    # Sorted and merged at every size: the groups that go on grow with the input.
    rows = source.join(groups.filter(going).select("length", "digit", "group").hint("merge"), ["length", "digit"]).select(
        "row", "id", "length", "group", "bytes")
    rows, start, width, step = scratch.table(rows, "round-0"), FIRST, FIRST * WIDER, 0
    spent = scratch.paths["round-0"]
    while not rows.isEmpty():
        step += 1
        split = rows.withColumn("digit", F.substring("bytes", start + 1, width))
        found = scratch.table(_split(split, "group", "digit").withColumn("next", F.monotonically_increasing_id()), f"groups-{step}")
        ends = F.col("n").isNull() | (F.col("length") <= start + width)
        met = split.join(found.hint("merge"), ["group", "digit"], "left").select(
            "row", "id", "length", F.col("next").alias("group"), "first", "n",
            F.when(ends, F.sha2("bytes", 256)).alias("sha"), F.when(~ends, F.col("bytes")).alias("bytes"), (~ends).alias("going"))
        path = fresh_dir(spark, f"exact-dedup-split-{step}")
        met.write.partitionBy("going").parquet(path)
        read = spark.read.schema(met.schema).parquet(path)
        out = out.unionByName(_leave(read.filter(~F.col("going")), F.col("sha")))
        rows = read.filter("going").select("row", "id", "length", "group", "bytes")
        scratch.drop(f"groups-{step}")
        remove(spark, spent)
        spent = f"{path}/going=true"
        start, width = start + width, width * WIDER
    return out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) per row: groups of equal texts.

    Texts are equal when their bytes are, after each run of ASCII white space has become one
    space. Of a group, the row with the smallest id stays. The sum is a result, not a key.

    Null texts count as empty and equal empty ones; empty texts are a group like any other. A
    row without an id comes after all ids: it stays only if its whole group has none, and
    keep_id is null then. Of rows that repeat id and text one is kept. Very long texts are told
    apart by as many rounds of bytes as they share, and are never cut. Rows are numbered in two
    scans of `docs`, which must come in the same order, as plain reads of files do; write `docs`
    first if it is computed. Other columns are ignored, whatever their names; an empty table
    gives an empty result.
    """
    return radix_groups(docs, id_col, text).drop("row").withColumnRenamed("id", id_col)


def drop_exact_copies(docs: DataFrame, row: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that exact_dedup keeps, all columns; `row` tells them apart."""
    dropped = radix_groups(docs, id_col, text, row).filter(~F.col("kept")).select(F.col("row").alias(row))
    return docs.join(dropped.hint("merge"), row, "left_anti")
