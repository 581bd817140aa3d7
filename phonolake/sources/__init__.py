"""Sources of phonolake."""
