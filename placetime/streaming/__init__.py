"""Structured Streaming forms of the jobs that refresh sensor and weather data."""
