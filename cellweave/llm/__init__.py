"""Training-data operators: deduplication, language identification, quality, packing and layout.

Nothing else in the library imports this subpackage.
"""
