"""Structured Streaming: an addition beyond request-and-report analysis."""
