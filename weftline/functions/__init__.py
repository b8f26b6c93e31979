"""Column expressions: vectors, text, tags, time, scores."""
