"""Entity annotations as tables: label sets, scores, schema forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .metrics import prf


def label_set(spans: DataFrame, label: str = "label") -> DataFrame:
    """O and the B- and I- forms of every span label, numbered in sorted order. One row per label."""
    forms = spans.select(F.explode(F.array(
        F.concat(F.lit("B-"), F.col(label)), F.concat(F.lit("I-"), F.col(label)))).alias("label")).distinct()
    numbered = forms.withColumn("label_id", F.row_number().over(Window.orderBy("label")))  # label rows only
    outside = spans.sparkSession.range(1).select(F.lit("O").alias("label"), F.lit(0).alias("label_id"))
    return outside.unionByName(numbered)


def entity_scores(gold: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    """Exact-match precision, recall, F1 and support per type from (key, type, start, end) rows.

    Both sides are grouped together, so that one shuffle finds support, predictions and hits.
    """
    sides = gold.select(key, "type", "start", "end", F.lit(1).alias("g"), F.lit(0).alias("p")).unionByName(
        predicted.select(key, "type", "start", "end", F.lit(0).alias("g"), F.lit(1).alias("p")))
    spans = sides.groupBy(key, "type", "start", "end").agg(F.max("g").alias("g"), F.max("p").alias("p"))
    sums = spans.groupBy("type").agg(F.sum("g").alias("support"), F.sum("p").alias("named"),
                                     F.sum(F.col("g") * F.col("p")).alias("hit"))
    return prf(sums)


def entity_averages(scores: DataFrame) -> DataFrame:
    """Micro, macro and support-weighted averages. `scores` has one row per type."""
    def ratio(a, b):
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    hit, named, support = F.sum("hit"), F.sum("named"), F.sum("support")
    micro_p, micro_r = ratio(hit, named), ratio(hit, support)
    wide = scores.agg(
        F.struct(F.lit("micro avg").alias("average"), micro_p.alias("precision"), micro_r.alias("recall"),
                 ratio(2 * micro_p * micro_r, micro_p + micro_r).alias("f1"), support.alias("support")).alias("a"),
        F.struct(F.lit("macro avg").alias("average"), *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")],
                 support.alias("support")).alias("b"),
        F.struct(F.lit("weighted avg").alias("average"), *[
            ratio(F.sum(F.col(c) * F.col("support")), support).alias(c) for c in ("precision", "recall", "f1")],
            support.alias("support")).alias("c"))
    return wide.select(F.explode(F.array("a", "b", "c")).alias("r")).select("r.*")


def label_counts(gold: DataFrame, predicted: DataFrame, label: str = "label") -> DataFrame:
    """Labels other than O in gold and predictions, over the union of both; missing is 0."""
    sides = gold.select(F.col(label).alias("label"), F.lit(1).alias("g"), F.lit(0).alias("p")).unionByName(
        predicted.select(F.col(label).alias("label"), F.lit(0).alias("g"), F.lit(1).alias("p")))
    return sides.filter(F.col("label") != "O").groupBy("label").agg(
        F.sum("g").alias("true_count"), F.sum("p").alias("predicted_count"))


def top_by_f1(scores: DataFrame, n: int = 10) -> DataFrame:
    return scores.orderBy(F.col("f1").desc(), "type").limit(n)


def schema_form(df: DataFrame) -> str:
    """`token` if examples come as token lists, else `span`."""
    return "token" if "tokens" in df.columns else "span"
