"""From findings, scores and entity labels to block, mask or allow."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..sources.policy import Policy
from .detection import severity_rank_col


def any_finding(found: Column, test) -> Column:
    return F.coalesce(F.exists(found, test), F.lit(False))


def decide_by_severity(found: Column) -> Column:
    """Any critical finding blocks, any medium or high one masks."""
    worst = F.array_max(F.transform(found, lambda f: severity_rank_col(f["severity"])))
    return F.when(worst >= 3, "block").when(worst >= 1, "mask").otherwise("allow")


def flag_block(found: Column, policy: Policy) -> Column:
    return any_finding(found, lambda f: f["name"].isin(*sorted(policy.block)) | (f["category"] == "Secret")
                       | f["severity"].isin("high", "critical"))


def flag_mask(found: Column, policy: Policy) -> Column:
    return any_finding(found, lambda f: f["name"].isin(*sorted(policy.mask)) | (f["category"] == "PII")
                       | ((f["category"] == "Network") & (f["severity"] == "medium")))


def flag_entity(labels: Column, policy: Policy, action: str) -> Column:
    """Some policy key for the action is contained in some upper-cased label."""
    keys = [k for k, a in policy.entity if a == action]
    if not keys:
        return F.lit(False)

    def hit(label: Column) -> Column:
        test = F.lit(False)
        for key in keys:
            test = test | F.contains(F.upper(label), F.lit(key))
        return test

    return F.coalesce(F.exists(labels, hit), F.lit(False))


def flag_email(found: Column, labels: Column) -> Column:
    by_name = any_finding(found, lambda f: F.contains(F.lower(f["name"]), F.lit("email address"))
                          | (F.lower(f["name"]) == "email"))
    by_label = F.coalesce(F.exists(labels, lambda x: F.endswith(F.upper(x), F.lit("EMAIL"))), F.lit(False))
    return by_name | by_label


def flag_secret(score: Column, policy: Policy) -> Column:
    return F.coalesce(score >= F.lit(policy.threshold("secret_block")), F.lit(False))


def flag_unsafe(score: Column, policy: Policy) -> Column:
    return F.coalesce(score >= F.lit(policy.threshold("ml_unsafe")), F.lit(False))


def confidence(score: Column) -> Column:
    return F.round(F.coalesce(score, F.lit(0.0)), 3)


def no_labels() -> Column:
    return F.array().cast("array<string>")


def decide(found: Column, secret_score: Column | None = None, unsafe_score: Column | None = None,
           labels: Column | None = None, policy: Policy | None = None) -> Column:
    """The policy decision. An e-mail address masks before anything else is asked."""
    policy = policy or Policy()
    secret = F.lit(None).cast("double") if secret_score is None else secret_score
    unsafe = F.lit(None).cast("double") if unsafe_score is None else unsafe_score
    labels = no_labels() if labels is None else labels
    blocked = (flag_block(found, policy) | flag_secret(secret, policy) | flag_unsafe(unsafe, policy)
               | flag_entity(labels, policy, "block"))
    masked = flag_mask(found, policy) | flag_entity(labels, policy, "mask")
    rules = F.when(blocked, "block").when(masked, "mask").otherwise("allow")
    if policy.email_override:
        return F.when(flag_email(found, labels), "mask").otherwise(rules)
    return rules
