"""Alignment, calendars, simulation and accounting."""
