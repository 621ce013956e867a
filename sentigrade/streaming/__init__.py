"""Structured Streaming counterparts of ingestion, deduplication and per-game aggregates."""
