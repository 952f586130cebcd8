"""Structured Streaming forms of the polling loop."""
