"""Registered queries over the given tables, each with its check in plain SQL where SQL can say it."""

from __future__ import annotations

import importlib
import sys
import traceback

from .base import ORACLES, QUERIES

MODULES = ["detection", "masking", "decisions", "sources", "cleaning", "features", "summaries", "sampling", "joins", "logs", "entities", "models", "metrics", "streams"]
FAILED: dict[str, str] = {}


def load() -> None:
    """Import all catalog modules; one that fails is reported and does not hide the others."""
    for name in MODULES:
        try:
            importlib.import_module(f"{__name__}.{name}")
        except Exception:
            if name not in FAILED:
                FAILED[name] = traceback.format_exc()
                print(f"catalog module {name} failed:\n{FAILED[name]}", file=sys.stderr, flush=True)


__all__ = ["FAILED", "ORACLES", "QUERIES", "load"]
