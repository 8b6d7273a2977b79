"""Structured Streaming variants of per-frame aggregates."""
