"""Structured Streaming forms of the sequential operators, over rows with an event time."""
