"""Readers of raw telemetry and of the driver's tables, and table sinks."""
