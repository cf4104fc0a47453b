"""Column functions: geometry, calendars, statistics."""
