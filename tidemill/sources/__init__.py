"""Scans, sinks and the bar recipes over the driver tables."""
