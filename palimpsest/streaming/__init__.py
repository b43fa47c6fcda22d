"""Changelog ingestion with Structured Streaming."""
