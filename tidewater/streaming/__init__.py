"""Structured Streaming forms of the chunked and stateful operators."""
