"""Indicators and trading rules."""
