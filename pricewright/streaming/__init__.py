"""Structured Streaming jobs: incremental page collection and request scoring."""
