"""Structured Streaming forms of the bar queries."""
