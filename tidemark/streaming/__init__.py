"""Structured Streaming entry points over the same operators."""
