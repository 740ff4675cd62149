"""Structured Streaming: a stream of rows scored by a fitted model."""
