"""Structured Streaming forms of sync, first write wins and throttling."""
