"""Structured Streaming: incremental cleaning of arriving catalogue files."""
