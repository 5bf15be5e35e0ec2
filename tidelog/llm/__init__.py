"""Training-data operators: token output, deduplication, fingerprints, models and packing.

Nothing else in the library imports this subpackage.
"""
