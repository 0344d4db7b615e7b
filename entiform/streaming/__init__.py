"""Structured Streaming forms of the lead run."""
