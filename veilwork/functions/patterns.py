"""Pattern specs: what counts as personal data or a secret, and how sure a hit must be."""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# Names, categories, severities and patterns decide the results
# and therefore have to be exactly these, in exactly this order.
# (name, category, severity, validator, pattern)
# ---------------------------------------------------------------------------
BUILTIN_PATTERNS = [
    ("Email Address", "PII", "medium", None,
     r"\b[a-zA-Z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"),
    ("US Phone Number", "PII", "medium", None,
     r"\b(?:\+1[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)\d{3}[-.\s]?\d{4}\b"),
    ("US SSN", "PII", "high", "ssn",
     r"\b\d{3}-\d{2}-\d{4}\b"),
    ("Credit Card Number", "PII", "high", "luhn",
     r"\b(?:\d[ -]?){13,19}\b"),
    ("Date of Birth (MM/DD/YYYY or MM-DD-YYYY)", "PII", "medium", None,
     r"\b(?:0?[1-9]|1[0-2])[/\-](?:0?[1-9]|[12]\d|3[01])[/\-](?:19|20)\d{2}\b"),
    ("IPv4 Address", "Network", "low", "ipv4",
     r"\b(?:\d{1,3}\.){3}\d{1,3}\b"),
    ("AWS Access Key ID", "Secret", "critical", None,
     r"\bAKIA[0-9A-Z]{16}\b"),
    ("AWS Secret Access Key (context)", "Secret", "critical", None,
     r"(?i)(?:aws|aws_secret_access_key|secret_access_key)\s*[:=]\s*([A-Za-z0-9/+=]{40})"),
    ("GitHub Token", "Secret", "critical", None,
     r"\b(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,255}\b"),
    ("Slack Token", "Secret", "critical", None,
     r"\b(?:xoxb|xoxp|xapp|xoxa|xoxr)-\d{10,13}-[a-zA-Z0-9\-]{24,}\b"),
    ("Stripe Secret Key", "Secret", "critical", None,
     r"\bsk_live_[0-9a-zA-Z]{24,}\b"),
    ("Google API Key", "Secret", "high", None,
     r"\bAIza[0-9A-Za-z\-_]{35}\b"),
    ("JWT (JSON Web Token)", "Secret", "high", None,
     r"\beyJ[a-zA-Z0-9_\-]{10,}\.[a-zA-Z0-9_\-]{10,}\.[a-zA-Z0-9_\-]{10,}\b"),
    ("Database URL (common schemes)", "Secret", "high", None,
     r"(?i)\b(?:postgres|mysql|mongodb|mssql|oracle|redis)://[^\s'\"`]+"),
    ("Private Key Block", "Secret", "critical", None,
     r"-----BEGIN (?:RSA|EC|DSA|OPENSSH|PGP) PRIVATE KEY-----[\s\S]+?"
     r"-----END (?:RSA|EC|DSA|OPENSSH|PGP) PRIVATE KEY-----"),
    ("Generic Credential Assignment", "Secret", "high", None,
     r"(?i)\b(password|pwd|pass|secret|token|api[-_ ]?key)\b\s*[:=]\s*([^\s'\"`]{6,})"),
    ("RSA Token", "Secret", "critical", None,
     r"(?i)\brsa[_-]?(token|key|secret)\b\s*[:=]\s*([A-Za-z0-9+/=]{8,128})"),
    ("SSH RSA Public Key", "Secret", "high", None,
     r"ssh-(rsa|ed25519|dss)\s+[A-Za-z0-9+/=]{40,}={0,2}"),
    ("RSA Token", "Secret", "critical", None,
     r"\bRSA[_-]?(TOKEN|KEY|SECRET)\b\s*[:=]\s*([A-Za-z0-9+/=]{8,128})"),
    ("SSH RSA Public Key", "Secret", "high", None,
     r"\bssh-(rsa|ed25519|dss)\s+[A-Za-z0-9+/=]{50,}\b"),
    ("OpenSSH Key Block", "Secret", "critical", None,
     r"-----BEGIN OPENSSH (?:PRIVATE|PUBLIC) KEY-----[\s\S]+?"
     r"-----END OPENSSH (?:PRIVATE|PUBLIC) KEY-----"),
    ("International Phone Number", "PII", "medium", None,
     r"\b\+(?:[1-9]\d{0,2})[\s\-]?(?:\(?\d{1,4}\)?[\s\-]?\d{3,})\b"),
    ("Date of Birth", "PII", "medium", None,
     r"(?<!\d)(?:"
     r"(?:19|20)\d{2}[-/.](?:0[1-9]|1[0-2])[-/.](?:0[1-9]|[12]\d|3[01])"
     r"|(?:0[1-9]|1[0-2])[-/.](?:0[1-9]|[12]\d|3[01])[-/.](?:19|20)\d{2}"
     r"|(?:0[1-9]|[12]\d|3[01])[-/.](?:0[1-9]|1[0-2])[-/.](?:19|20)\d{2}"
     r")(?!\d)"),
]

# Severity order, lowest first.
SEVERITY_ORDER = ["low", "medium", "high", "critical"]
# ---------------------------------------------------------------------------

# Short names for the specs above, same order; they name queries and select subsets.
SLUGS = [
    "email", "us_phone", "ssn", "credit_card", "dob_us", "ipv4", "aws_key_id", "aws_secret",
    "github_token", "slack_token", "stripe_key", "google_key", "jwt", "db_url", "private_key",
    "generic_credential", "rsa_token", "ssh_key", "rsa_token_upper", "ssh_key_50",
    "openssh_block", "intl_phone", "dob",
]

# What a text must have for a spec to match at all; each entry follows from its pattern. These
# tests cost a fraction of the pattern, and most texts fail them.
# Literals, of which one must occur. Specs share them where they can: the same test in several
# conditions is evaluated once.
ANCHORS = {
    "email": ["@"],
    "dob_us": ["19", "20"],
    "aws_key_id": ["AKIA"],
    "aws_secret": [":", "="],
    "github_token": ["_"],
    "slack_token": ["xox", "xapp-"],
    "stripe_key": ["_"],
    "google_key": ["AIza"],
    "jwt": ["eyJ"],
    "db_url": ["://"],
    "private_key": ["-----BEGIN "],
    "generic_credential": [":", "="],
    "rsa_token": [":", "="],
    "ssh_key": ["ssh-"],
    "rsa_token_upper": ["RSA"],
    "ssh_key_50": ["ssh-"],
    "openssh_block": ["-----BEGIN "],
    "intl_phone": ["+"],
    "dob": ["19", "20"],
}
# Words, of which one must occur in any letter case:
KEYWORDS = {
    "aws_secret": ["aws", "secret_access_key"],
    "db_url": ["postgres://", "mysql://", "mongodb://", "mssql://", "oracle://", "redis://"],
    "generic_credential": ["pass", "pwd", "secret", "token", "api"],
    "rsa_token": ["rsa"],
}
# Letters that fold to s and i but do not lower-case to them.
ODD_FOLDS = ["\u017f", "\u0131"]
# Simple patterns, which must occur after a first test for any digit:
DIGIT = r"\d"
GATES = {
    "us_phone": r"\d{3}[-.\s]?\d{4}",
    "ssn": r"\d{3}-\d{2}-\d{4}",
    "credit_card": r"\d[ -]?\d[ -]?\d[ -]?\d[ -]?\d[ -]?\d[ -]?\d[ -]?\d",
    "dob_us": r"[/\-](?:19|20)\d{2}",
    "ipv4": r"\d\.\d{1,3}\.\d{1,3}\.\d",
    "dob": r"[-/.]\d{2}[-/.]",
    "intl_phone": r"\+[1-9]",
    "github_token": r"gh[pousr]_[A-Za-z0-9]{36}",
    "stripe_key": "sk_live_",
}

# The only characters a match can begin with, as a look-ahead that is tried before the dearer
# word-boundary test. Follows from the pattern as well.
LEADS = {
    "us_phone": r"[+(\p{Nd}]",
    "ssn": r"\p{Nd}",
    "credit_card": r"\p{Nd}",
    "dob_us": r"[0-9]",
    "ipv4": r"\p{Nd}",
    "intl_phone": r"\+",
    "dob": r"[0-3]",
}


@dataclass(frozen=True)
class PatternSpec:
    """One detector. `validator` names an entry of the validator registry."""

    name: str
    category: str
    severity: str
    pattern: str
    validator: str | None = None
    slug: str | None = None
    anchor: object = None
    lead: str | None = None
    keywords: object = None
    gate: str | None = None

    def java(self) -> str:
        """The pattern in Java's dialect, led by its first-character test."""
        flags, body = java_pattern(self.pattern).split(")", 1)
        return f"{flags})(?={self.lead}){body}" if self.lead else f"{flags}){body}"


def builtin_specs(*slugs: str) -> list[PatternSpec]:
    """All built-in specs in order, or only those asked for."""
    specs = [
        PatternSpec(name, category, severity, pattern, validator, slug, ANCHORS.get(slug), LEADS.get(slug),
                    KEYWORDS.get(slug), GATES.get(slug))
        for slug, (name, category, severity, validator, pattern) in zip(SLUGS, BUILTIN_PATTERNS)
    ]
    return [s for s in specs if s.slug in slugs] if slugs else specs


def severity_rank(severity: str) -> int:
    return SEVERITY_ORDER.index(severity) if severity in SEVERITY_ORDER else 0


# What the patterns' classes mean for text: word characters are letters, numbers and the
# underscore (no combining marks), digits are all decimal digits, white space includes the
# four ASCII separators. Java's own classes differ, so they are spelled out; the white space
# class needs the flag U. A negated class of several plain ranges is avoided: Java's type checks
# on those do not scale over threads.
WORD = r"[\p{L}\p{N}_]"
SPACE = r"\s\x1c-\x1f"
BOUNDARY = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"


def java_pattern(pattern: str) -> str:
    """The same language for java.util.regex."""
    out, in_class, i = [], False, 0
    while i < len(pattern):
        two = pattern[i:i + 2]
        if two == r"\b" and not in_class:
            out.append(BOUNDARY)
        elif two == r"\d":
            out.append(r"\p{Nd}")
        elif two == r"\s":
            out.append(SPACE if in_class else f"[{SPACE}]")
        elif two == r"\S" and in_class:
            out.append(f"[^{SPACE}]")
        elif two == r"\w":
            out.append(WORD[1:-1] if in_class else WORD)
        elif two.startswith("\\"):
            out.append(two)
        else:
            if two[0] == "[":
                in_class = True
            elif two[0] == "]":
                in_class = False
            out.append(two[0])
            i += 1
            continue
        i += 2
    body = "".join(out)
    return "(?iU)" + body[4:] if body.startswith("(?i)") else "(?U)" + body
