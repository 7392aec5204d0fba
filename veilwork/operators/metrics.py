"""Classifier metrics as aggregations; curves by running totals over score buckets."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window, functions as F

LOG_LOSS_CLIP = 2.220446049250313e-16


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(truth, predicted, n): one row per pair that occurs."""
    return df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, truth: str, predicted: str, classes: list) -> DataFrame:
    """One row per true class, one column per predicted class, zeros filled."""
    wide = df.groupBy(F.col(truth).alias("truth")).pivot(predicted, classes).agg(F.count(F.lit(1))).na.fill(0)
    return wide.select("truth", *[F.col(f"`{c}`").alias(f"predicted_{c}") for c in classes])


def _ratio(part, whole):
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def per_label(pairs: DataFrame) -> DataFrame:
    """label, precision, recall, f1, support from (truth, predicted, n)."""
    both = pairs.select(F.explode(F.array(
        F.struct(F.col("truth").alias("label"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("named"),
                 F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("bigint").alias("support"),
                 F.col("n").alias("named"), F.lit(0).cast("bigint").alias("hit")))).alias("r")).select("r.*")
    sums = both.groupBy("label").agg(F.sum("support").alias("support"), F.sum("named").alias("named"), F.sum("hit").alias("hit"))
    return prf(sums)


def prf(sums: DataFrame, *keys: str) -> DataFrame:
    """precision, recall, f1 from (label, support, named, hit); a zero denominator gives 0."""
    rated = sums.withColumns({"precision": _ratio(F.col("hit"), F.col("named")),
                              "recall": _ratio(F.col("hit"), F.col("support"))})
    total = F.col("precision") + F.col("recall")
    return rated.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), total))


def report_rows(pairs: DataFrame) -> DataFrame:
    """Classification report: per class, accuracy, macro and support-weighted averages.

    `pairs` has one row per pair of classes, so everything here is small.
    """
    labels = per_label(pairs)
    rows = labels.select(F.col("label").cast("string").alias("label"), "precision", "recall", "f1", "support")
    averages = labels.agg(
        F.sum("hit").alias("hit"), F.sum("support").alias("n"),
        *[F.avg(c).alias(f"m_{c}") for c in ("precision", "recall", "f1")],
        *[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(f"w_{c}") for c in ("precision", "recall", "f1")])
    extra = averages.select(F.explode(F.array(
        F.struct(F.lit("accuracy").alias("label"), *[(F.col("hit") / F.col("n")).alias(c) for c in ("precision", "recall", "f1")], F.col("n").alias("support")),
        F.struct(F.lit("macro avg").alias("label"), *[F.col(f"m_{c}").alias(c) for c in ("precision", "recall", "f1")], F.col("n").alias("support")),
        F.struct(F.lit("weighted avg").alias("label"), *[F.col(f"w_{c}").alias(c) for c in ("precision", "recall", "f1")], F.col("n").alias("support")),
    )).alias("r")).select("r.*")
    return rows.unionByName(extra)


def cumulative(df: DataFrame, truth: str, score: str, buckets: int = 1000) -> DataFrame:
    """Per distinct score: positives, negatives, and those with a higher score.

    Ties are summed first. Running totals are taken inside score buckets and shifted by the
    totals of the higher buckets. The bucket limits are approximate quantiles, which spread
    any score distribution over the buckets; whatever the limits are, the totals are exact.
    """
    ties = df.groupBy(F.col(score).alias("score")).agg(
        F.sum(F.when(F.col(truth) == 1, 1).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col(truth) == 1, 0).otherwise(1)).alias("neg"))
    limits = sorted(set(df.approxQuantile(score, [i / buckets for i in range(1, buckets)], 0.5 / buckets)))
    splits = [-float("inf"), *(limits or [0.0]), float("inf")]
    placed = Bucketizer(splits=splits, inputCol="score", outputCol="bucket").transform(ties)
    totals = placed.groupBy("bucket").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    above = Window.orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    shifts = totals.select("bucket", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in ("p", "n")])
    inner = Window.partitionBy("bucket").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)
    run = placed.join(shifts, "bucket")
    return run.select(
        "score", "pos", "neg",
        (F.col("p_above") + F.coalesce(F.sum("pos").over(inner), F.lit(0))).alias("pos_above"),
        (F.col("n_above") + F.coalesce(F.sum("neg").over(inner), F.lit(0))).alias("neg_above"))


def _with_totals(runs: DataFrame, df: DataFrame, truth: str) -> DataFrame:
    n_pos, n_neg = df.agg(F.sum(F.when(F.col(truth) == 1, 1).otherwise(0)),
                          F.sum(F.when(F.col(truth) == 1, 0).otherwise(1))).first()
    return runs.withColumns({"n_pos": F.lit(n_pos), "n_neg": F.lit(n_neg)})


def roc_curve(df: DataFrame, truth: str, score: str) -> DataFrame:
    """threshold, false and true positive rate at every distinct score."""
    runs = _with_totals(cumulative(df, truth, score), df, truth)
    return runs.select(F.col("score").alias("threshold"),
                       ((F.col("neg_above") + F.col("neg")) / F.col("n_neg")).alias("fpr"),
                       ((F.col("pos_above") + F.col("pos")) / F.col("n_pos")).alias("tpr"))


def pr_curve(df: DataFrame, truth: str, score: str) -> DataFrame:
    """threshold, precision and recall at every distinct score."""
    runs = _with_totals(cumulative(df, truth, score), df, truth)
    taken = F.col("pos_above") + F.col("pos")
    return runs.select(F.col("score").alias("threshold"),
                       (taken / (taken + F.col("neg_above") + F.col("neg"))).alias("precision"),
                       (taken / F.col("n_pos")).alias("recall"))


def roc_auc(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Area under the ROC curve; ties count half."""
    area = F.sum(F.col("neg") * (F.col("pos_above") + F.col("pos") / 2.0))
    return cumulative(df, truth, score).agg((area / (F.sum("pos") * F.sum("neg"))).alias("roc_auc"))


def average_precision(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Sum over distinct scores of recall step times precision."""
    taken = F.col("pos_above") + F.col("pos")
    precision = taken / (taken + F.col("neg_above") + F.col("neg"))
    return cumulative(df, truth, score).agg(
        (F.sum(F.col("pos") * precision) / F.sum("pos")).alias("average_precision"))


def brier(truth: str, score: str):
    return F.avg(F.pow(F.col(score) - F.col(truth), F.lit(2)))


def log_loss(truth: str, score: str):
    """Cross entropy with probabilities clipped away from 0 and 1."""
    p = F.least(F.greatest(F.col(score), F.lit(LOG_LOSS_CLIP)), F.lit(1 - LOG_LOSS_CLIP))
    return F.avg(-F.when(F.col(truth) == 1, F.ln(p)).otherwise(F.ln(1 - p)))
