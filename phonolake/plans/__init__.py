"""Plans of phonolake."""
