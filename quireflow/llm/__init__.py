"""Training-data operators: filters, near-duplicate search, token accounting, mixing and packing.

Nothing outside this folder imports it, and it imports nothing from the rest of the library.
"""
