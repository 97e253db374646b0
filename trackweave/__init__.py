"""Interval, signal-track and annotation analytics as lazy PySpark plans."""
