"""Operators for large training-data pipelines (mixing, chat, scoring, filtering, dedup, output)."""
