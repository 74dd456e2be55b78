"""Incremental click / impression statistics with Structured Streaming."""
