"""Query languages; each becomes a path or one DataFrame plan."""
