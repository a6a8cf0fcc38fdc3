"""Structured Streaming forms of the catalogue scan and the running means."""
