"""Structured Streaming jobs over events and articles."""
