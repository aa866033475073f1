"""Training-data operators: dedup, search, classification, filtering, packing, tokenising, extraction.

Nothing else in the library imports this subpackage.
"""
