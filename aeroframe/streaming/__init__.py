"""Structured Streaming forms of running operators."""
