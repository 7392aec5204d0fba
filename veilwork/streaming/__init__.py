"""Structured Streaming on the same columns and operators as batch."""
