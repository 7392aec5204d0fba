"""Operators for training corpora: language ID, deduplication, packing, mixing, scoring, sharding."""
