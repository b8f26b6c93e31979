"""Operators over facts, links, entities and documents; each takes and returns frames."""
