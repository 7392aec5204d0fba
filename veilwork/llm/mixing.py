"""Mixing sources to target weights by Poisson replication.

Each document is repeated as often as a Poisson distribution says whose mean is its source's
repetition rate, inverted at a number hashed from seed and document; the copies are then
shuffled globally by a second hash. Expected shares are exact, nothing is coordinated between
documents, and reruns agree.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import Scratch


def hash_unit(*parts: Column) -> Column:
    """A number in (0, 1) from 52 bits of an MD5 over the parts, null written as `~`."""
    key = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts])
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def poisson_steps(rates: DataFrame) -> DataFrame:
    """(_source, low, steps): a Poisson distribution function at low, low + 1, ... for each (_source, rate).

    Terms are products of rate / k, taken as sums of logarithms from `low` on and scaled by the
    largest one, so no rate is too large for them. What lies 12 deviations and 24 off the mean has a
    share of less than 1e-30 and is left out; a rate has about 24 times its root in steps.
    """
    reach = F.lit(12) * F.sqrt("rate") + 24
    low, high = F.greatest(F.floor(F.col("rate") - reach), F.lit(0)), F.ceil(F.col("rate") + reach)
    terms = rates.filter("rate > 0").select("_source", "rate", F.explode(F.sequence(low, high)).alias("k"), low.alias("low"))
    whole = Window.partitionBy("_source")
    upto = whole.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    terms = terms.withColumn("log", F.sum(F.when(F.col("k") > F.col("low"), F.ln(F.col("rate") / F.col("k"))).otherwise(0.0)).over(upto))
    terms = terms.withColumn("term", F.exp(F.col("log") - F.max("log").over(whole)))
    terms = terms.withColumn("step", F.sum("term").over(upto) / F.sum("term").over(whole))
    return terms.groupBy("_source").agg(F.min("k").alias("low"), F.array_sort(F.collect_list("step")).alias("steps"))


def repetition_rates(docs: DataFrame, source: str, temperature: float, total: float | None,
                     weights: Mapping[str | None, float] | None) -> DataFrame:
    """(source, n, rate): mean repetitions that bring each source to its share of `total` documents."""
    counts = docs.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        counts = counts.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(temperature)))
    else:
        rows = [(k, float(w)) for k, w in weights.items()]
        given = docs.sparkSession.createDataFrame(rows, "name string, weight double")
        counts = counts.join(F.broadcast(given), F.col("source").eqNullSafe(F.col("name")), "left").drop("name")
        counts = counts.withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    # Two numbers, whatever the number of sources.
    size, mass = counts.agg(F.sum("n"), F.sum("weight")).first()
    wanted = float(total if total is not None else size or 0)
    return counts.select("source", "n", (F.lit(wanted) * F.col("weight") / F.lit(float(mass or 1.0)) / F.col("n")).alias("rate"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source: str = "source", *, temperature: float = 0.5,
                weights: Mapping[str | None, float] | None = None, total: float | None = None, seed: int = 20, row: str | None = None) -> DataFrame:
    """The rows of `docs` repeated and shuffled, with columns _copy (0, 1, ...) and _order.

    Target weights are `weights` by source, or in proportion to n ** temperature. A source not
    in `weights` gets nothing. `total` is the expected number of rows, by default that of
    `docs`. Rows are dealt to partitions at random by _order, a
    hash of seed, document and copy, and come sorted by it within a partition.

    Null sources are a source of their own. Null texts and other nulls are data like any other.
    Rows without an id draw by a hash of all their columns, rows that repeat an id draw alike;
    with `row` (a column that tells rows apart) each row draws for itself. Texts of any length
    travel whole; rows with one _order (a repeated id) come in any order. Columns _copy and
    _order, in whatever letter case, are replaced if `docs` has them; other columns are kept. An
    empty table gives an empty result.
    """
    rates = repetition_rates(docs, source, temperature, total, weights)
    # Written, so that Spark knows its size: few sources are broadcast, many are joined by sorting.
    rates = Scratch(docs.sparkSession, "mixing").table(poisson_steps(rates.select(F.col("source").alias("_source"), "rate")), "rates")
    # The row travels as one struct, so that no name of its can clash.
    names = [c for c in docs.columns if c.lower() not in ("_copy", "_order")]
    rest = F.xxhash64(*[F.col(f"`{c}`") for c in names])
    key = F.col(row or id_col).cast("string")
    if row is None:
        key = F.coalesce(key, F.concat(F.lit("~"), rest.cast("string")))
    drawn = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"), F.col(source).alias("source"), key.alias("key"))
    unit = hash_unit(F.lit(str(seed)), F.col("key"))
    count = (F.col("low") + F.size(F.filter("steps", lambda s: s < unit))).cast("int")
    joined = drawn.join(rates, F.col("source").eqNullSafe(F.col("_source"))).select("doc", "key", count.alias("count"))
    repeated = joined.filter("count > 0").select("doc", "key", F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("_copy"))
    order = F.md5(F.concat_ws("|", F.lit(f"order{seed}"), "key", F.col("_copy").cast("string")))
    repeated = repeated.select("doc.*", "_copy", order.alias("_order"))
    return repeated.repartition(F.col("_order")).sortWithinPartitions("_order")
