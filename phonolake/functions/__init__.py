"""Functions of phonolake."""
