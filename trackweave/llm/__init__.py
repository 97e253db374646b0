"""Training-data operators: licence scans, archives, deduplication, mixing, extraction, packing.

Nothing else in the library imports this subpackage.
"""
