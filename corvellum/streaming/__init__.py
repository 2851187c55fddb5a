"""Structured Streaming: incremental ingest and event windows."""
