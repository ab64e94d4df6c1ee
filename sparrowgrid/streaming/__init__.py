"""Streams and per-key state."""
