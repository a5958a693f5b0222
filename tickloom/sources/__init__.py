"""Tick scans, calendars, stage tables and file sources."""
