"""Whole queries, strategies and the driver's query list."""
