"""Streaming forms of batch operators; each gives the batch result for the same events."""
