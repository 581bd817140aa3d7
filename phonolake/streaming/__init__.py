"""Streaming of phonolake."""
