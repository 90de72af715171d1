"""Structured Streaming forms of the trace and news operators."""
