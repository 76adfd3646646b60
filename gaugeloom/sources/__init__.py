"""Scans of and sinks for evaluation data."""
