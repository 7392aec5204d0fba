"""The unified analysis of a table or stream of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.decisions import confidence, decide, no_labels
from ..functions.detection import finding_names, with_findings
from ..functions.masking import mask, mask_entities, safe_store_text
from ..functions.patterns import PatternSpec
from ..sources.policy import Policy

# ---------------------------------------------------------------------------
# Names of the detectors an analysis reports, and of its policy events.
# ---------------------------------------------------------------------------
SOURCES = ["regex", "bert_secret_clf_v2", "pii_ner_v3"]
MODEL, NO_MODEL = "ensemble", "none"
POLICY_IDS = {"allow": "chat_message", "mask": "chat_message_masked", "block": "chat_message_blocked"}
# ---------------------------------------------------------------------------


def analyze(df: DataFrame, text: str = "text", secret_score: Column | None = None,
            unsafe_score: Column | None = None, entities: Column | None = None,
            labels: Column | None = None, policy: Policy | None = None,
            specs: list[PatternSpec] | None = None, overlap: str = "merge") -> DataFrame:
    """Adds findings, action, masked output, confidences, entities and sources to each row.

    Row by row, without a shuffle; the same code serves batch and streaming frames. Scores,
    entities and labels come from other models as columns and may be absent; labels come with
    the entities they belong to, so that what a label asks to mask can be masked.
    """
    if labels is not None and entities is None:
        raise ValueError("labels need the entities they belong to")
    found, body = F.col("findings"), F.col(text)
    entity_list = F.coalesce(entities, no_labels()) if entities is not None else no_labels()
    action = decide(found, secret_score, unsafe_score, labels, policy)
    masked = mask_entities(mask(body, found, "partial", overlap), F.col("pii_entities"))
    scored = unsafe_score.isNotNull() if unsafe_score is not None else F.lit(False)
    missing = F.lit(None).cast("double")
    return (
        with_findings(df, text, "findings", specs)
        .withColumns({
            "action": action,
            "pii_entities": F.array_sort(F.array_distinct(entity_list)),
            "secret_confidence": confidence(missing if secret_score is None else secret_score),
            "ml_confidence": confidence(missing if unsafe_score is None else unsafe_score),
            "sources": F.concat(F.array(*[F.lit(s) for s in SOURCES]),
                                F.array(F.when(scored, MODEL).otherwise(NO_MODEL))),
            "regex_findings": finding_names(found),
        })
        .withColumn("masked_output", F.when(F.col("action") == "mask", masked))
    )


def attach_scores(df: DataFrame, scores: DataFrame, key: str, *score_cols: str) -> DataFrame:
    """Model scores by id; a text without a score gets 0."""
    joined = df.join(scores.select(key, *score_cols), key, "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in score_cols})


def with_scan_status(df: DataFrame, action: str = "action", default: str = "block") -> DataFrame:
    """A row whose analysis failed (null action) gets a status and a default action."""
    failed = F.col(action).isNull()
    return df.withColumns({
        "scan_status": F.when(failed, "failed").otherwise("ok"),
        action: F.coalesce(F.col(action), F.lit(default)),
    })


def policy_events(analyzed: DataFrame, text: str = "text") -> DataFrame:
    """What an analysed message leaves in the policy log: id, findings, safe text."""
    action = F.col("action")
    policy_id = F.when(action == "mask", POLICY_IDS["mask"]).when(
        action == "block", POLICY_IDS["block"]).otherwise(POLICY_IDS["allow"])
    return analyzed.withColumns({
        "policy_id": policy_id,
        "all_findings": F.concat("regex_findings", "pii_entities"),
        "safe_text": safe_store_text(action, F.col(text), F.col("masked_output")),
    })
