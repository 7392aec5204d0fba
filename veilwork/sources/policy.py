"""The policy: which findings, entity labels and scores lead to block or mask."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

# ---------------------------------------------------------------------------
# The policy in force unless a file says otherwise.
# ---------------------------------------------------------------------------
BLOCK_CATEGORIES = [
    "Credit Card Number", "US SSN", "API Key", "JWT", "Database URL (common schemes)",
    "Generic Credential Assignment", "Access Token", "Bank Account Number", "Routing Number",
    "Private Key", "Password or Secret Value", "RSA Token", "SSH RSA Public Key",
    "OpenSSH Key Block", "Account Number",
]
MASK_CATEGORIES = [
    "Email Address", "Email", "EMAIL", "E-mail", "B-EMAIL", "I-EMAIL", "US Phone Number",
    "International Phone Number", "Physical Address", "Person Name", "IP Address",
    "IPv4 Address", "Date of Birth", "Postal Code", "Organization Name",
]
ENTITY_POLICY = {
    "NAME": "mask", "Email Address": "mask", "EMAIL_ADDRESS": "mask", "Email": "mask",
    "EMAIL": "mask", "PHONE": "mask", "ADDRESS": "mask", "ID": "block", "DOB": "mask",
    "ORGANIZATION": "mask",
}
THRESHOLDS = {"secret_block": 0.70, "ml_unsafe": 0.80, "regex_confidence": 0.60, "pii_confidence": 0.40}
# Used where a policy names no thresholds.
FALLBACK_THRESHOLDS = {"secret_block": 0.7, "ml_unsafe": 0.65}
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Policy:
    block: frozenset = field(default_factory=lambda: frozenset(BLOCK_CATEGORIES))
    mask: frozenset = field(default_factory=lambda: frozenset(MASK_CATEGORIES))
    entity: tuple = tuple(ENTITY_POLICY.items())
    thresholds: tuple = tuple(THRESHOLDS.items())
    email_override: bool = True

    def threshold(self, name: str) -> float:
        return dict(self.thresholds).get(name, FALLBACK_THRESHOLDS[name])


def load_policy(spark: SparkSession, path: str) -> Policy:
    """A YAML policy from any path Spark can read. An unreadable one is an empty policy."""
    import yaml

    try:
        text = spark.read.text(path, wholetext=True).first()[0]
        raw = yaml.safe_load(text) or {}
    except Exception:
        raw = {}
    return Policy(
        block=frozenset(raw.get("block_categories") or []),
        mask=frozenset(raw.get("mask_categories") or []),
        entity=tuple((raw.get("pii_entity_policy") or {}).items()),
        thresholds=tuple((raw.get("thresholds") or FALLBACK_THRESHOLDS).items()),
    )


def policy_table(spark: SparkSession, policy: Policy | None = None) -> DataFrame:
    """The policy as rows (kind, name, value), for joins and reports."""
    p = policy or Policy()
    rows = [("block", n, "block") for n in sorted(p.block)]
    rows += [("mask", n, "mask") for n in sorted(p.mask)]
    rows += [("entity", n, a) for n, a in p.entity]
    rows += [("threshold", n, f"{v:.2f}") for n, v in p.thresholds]
    return spark.createDataFrame(rows, "kind string, name string, value string")
