"""Structured Streaming counterparts of the time-driven operators."""
