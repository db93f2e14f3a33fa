"""Column expressions: geometry, time, text, weather."""
