"""Streams: parts that arrive in chunks, and event-time windows."""
