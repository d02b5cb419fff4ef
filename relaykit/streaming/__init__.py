"""Structured Streaming: loading by key, change events, alerts."""
