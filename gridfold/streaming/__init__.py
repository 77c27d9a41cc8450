"""Structured Streaming: the watched register folder."""
