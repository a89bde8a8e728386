"""Structured Streaming: score arriving observations against fitted tables."""
