"""Structured Streaming: ingest, per-session state, windows over events."""
