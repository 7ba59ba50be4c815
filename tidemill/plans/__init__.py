"""Experiments over configurations, symbols and windows."""
