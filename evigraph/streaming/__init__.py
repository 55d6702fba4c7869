"""Structured Streaming versions of telemetry queries."""
