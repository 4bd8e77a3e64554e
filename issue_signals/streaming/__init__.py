"""Structured Streaming forms of ingest, analysis and alerting."""
