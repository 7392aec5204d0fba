"""Model scores that come as a stream of their own, attached to the messages they belong to."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans.analyze import with_scan_status


def attach_score_stream(messages: DataFrame, scores: DataFrame, key: str, at: str, scored_at: str, score: str, wait: str = "10 minutes",
                        early: str = "1 minute", late: str = "1 hour") -> DataFrame:
    """Each message once, with the score whose time lies from `early` before to `wait` after it, or with null.

    Both streams have watermarks `late` behind their newest times. Either side may arrive first;
    what waits for the other is kept until the watermark has passed its window, so state follows
    the rate of messages and not their number. A message without a score comes out once the
    watermark says that none can come any more. A score outside the window counts as none.
    """
    left = messages.withWatermark(at, late).alias("m")
    right = scores.select(F.col(key).alias("_key"), F.col(scored_at).alias("_scored_at"), F.col(score)).withWatermark("_scored_at", late).alias("s")
    fits = ((F.col(f"m.{key}") == F.col("s._key")) & (F.col("s._scored_at") >= F.col(f"m.{at}") - F.expr(f"INTERVAL {early}"))
            & (F.col("s._scored_at") <= F.col(f"m.{at}") + F.expr(f"INTERVAL {wait}")))
    return left.join(right, fits, "left_outer").select("m.*", F.col(f"s.{score}").alias(score))


def decide_scored(messages: DataFrame, score: str, threshold: float, default: str = "block") -> DataFrame:
    """allow or block by the score; a message whose score never came has failed its scan and gets the default."""
    action = F.when(F.col(score) >= threshold, "block").when(F.col(score).isNotNull(), "allow")
    return with_scan_status(messages.withColumn("action", action), "action", default)
