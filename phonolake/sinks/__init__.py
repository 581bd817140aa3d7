"""Sinks of phonolake."""
