"""Structured Streaming delivery of snapshot runs."""
