"""Counts over datasets and findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.detection import with_findings


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def class_balance(df: DataFrame, source: str, label: str, classes: Sequence[str]) -> DataFrame:
    """Source by class matrix; a missing cell is 0."""
    return df.groupBy(source).pivot(label, list(classes)).agg(F.count(F.lit(1))).na.fill(0)


def findings_summary(df: DataFrame, text: str = "text") -> DataFrame:
    """Findings by category, severity and name; texts by how many they touch.

    Counted within each text first, so what is shuffled is a row per kind and task.
    """
    found = with_findings(df, text, "_found").select("_found")
    kinds = F.array_distinct(F.transform("_found", lambda f: F.struct(f["category"].alias("category"), f["severity"].alias("severity"), f["name"].alias("name"))))
    counted = F.transform(kinds, lambda k: F.struct(k.alias("kind"), F.size(F.filter("_found", lambda f: f["name"] == k["name"])).alias("n")))
    return found.select(F.explode(counted).alias("c")).groupBy("c.kind").agg(
        F.sum("c.n").alias("findings"), F.count(F.lit(1)).alias("texts")).select("kind.*", "findings", "texts")


LEVELS = ["name", "category", "severity", "action", "all"]


def daily_findings(df: DataFrame, day: str, action: str, found: str = "findings") -> DataFrame:
    """(day, level, value, findings, texts, matches) of analysed texts: one pass for all levels of LEVELS.

    A text counts once per value, whatever number of findings it has of it; texts without findings
    count for their action and for all. `matches` is a mergeable sketch of the distinct matched
    strings. Days add up without the texts (`over_days`), because no text is in two.
    """
    each = F.transform(F.col(found), lambda f, i: F.struct(f["match"].alias("match"), F.lit(1).alias("finding"), F.array(
        *[F.struct(F.lit(level).alias("level"), f[level].alias("value"),
                   # A value counts the text where it comes first.
                   (F.array_position(F.transform(F.col(found), lambda g: g[level]), f[level]) == i + 1).cast("int").alias("text"))
          for level in ("name", "category", "severity")],
        *[F.struct(F.lit(level).alias("level"), value.alias("value"), (i == 0).cast("int").alias("text"))
          for level, value in (("action", F.col(action)), ("all", F.lit("")))]).alias("keys")))
    none = F.array(F.struct(F.lit(None).cast("string").alias("match"), F.lit(0).alias("finding"), F.array(
        *[F.struct(F.lit(level).alias("level"), value.alias("value"), F.lit(1).alias("text"))
          for level, value in (("action", F.col(action)), ("all", F.lit("")))]).alias("keys")))
    rows = df.select(F.col(day).alias("day"), F.explode(F.when(F.size(found) > 0, each).otherwise(none)).alias("f"))
    rows = rows.select("day", "f.match", "f.finding", F.explode("f.keys").alias("k"))
    return rows.groupBy("day", "k.level", "k.value").agg(F.sum("finding").alias("findings"), F.sum("k.text").alias("texts"),
                                                         F.hll_sketch_agg("match").alias("matches"))


def over_days(daily: DataFrame) -> DataFrame:
    """(level, value, findings, texts, distinct_matches) of all days together; the last within about 2 per cent."""
    return daily.groupBy("level", "value").agg(F.sum("findings").alias("findings"), F.sum("texts").alias("texts"),
                                               F.hll_sketch_estimate(F.hll_union_agg("matches")).alias("distinct_matches"))


def top_terms(weights: DataFrame, term: str, weight: str, n: int = 20) -> DataFrame:
    """The n lowest (safe) and n highest (unsafe) weighted terms."""
    safe = weights.orderBy(F.col(weight), term).limit(n).withColumn("label", F.lit("safe"))
    unsafe = weights.orderBy(F.col(weight).desc(), term).limit(n).withColumn("label", F.lit("unsafe"))
    return safe.unionByName(unsafe)
