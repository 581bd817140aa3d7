"""Operators of phonolake."""
