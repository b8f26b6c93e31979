"""Training-data operators: URL filters, duplicate removal, scoring, extraction, mixing and packing.

Nothing outside this folder imports it.
"""
