"""Conversation history made safe to send on."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.masking import context_text, normalize_masked_email
from ..plans.analyze import analyze
from ..sources.policy import Policy
from .ranking import first_per_key

MAX_TURNS = 20
# Fixed value: the instruction that leads every context.
SYSTEM_NOTE = (
    "You may see placeholders like [EMAIL_REDACTED] or [REDACTED_PII]. "
    "Those indicate sensitive data that was removed. Proceed normally using "
    "the remaining context to answer the user's request."
)


def sanitize_history(turns: DataFrame, conv: str, turn: str, max_turns: int = MAX_TURNS,
                     drop_assistant: bool = False, policy: Policy | None = None) -> DataFrame:
    """The last turns of every conversation, each analysed again and made safe.

    Assistant turns are dropped after the last turns are taken, not before.
    """
    recent = first_per_key(turns, [conv], [F.col(turn).desc()], max_turns, "_age").drop("_age")
    if drop_assistant:
        recent = recent.filter(F.col("role") != "assistant")
    done = analyze(recent, "text", policy=policy)
    return done.select(conv, turn, "role", context_text(
        F.col("action"), F.col("text"), F.col("masked_output")).alias("content"))


def build_context(turns: DataFrame, conv: str, turn: str, max_turns: int = MAX_TURNS,
                  policy: Policy | None = None) -> DataFrame:
    """Safe history plus one leading system row per conversation, at turn -1."""
    history = sanitize_history(turns, conv, turn, max_turns, policy=policy)
    note = turns.select(conv).distinct().select(
        conv, F.lit(-1).cast("bigint").alias(turn), F.lit("system").alias("role"), F.lit(SYSTEM_NOTE).alias("content"))
    return history.unionByName(note).withColumn("content", normalize_masked_email(F.col("content")))
