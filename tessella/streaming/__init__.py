"""Structured Streaming: replies split while they arrive, event windows, continuous indexing."""
