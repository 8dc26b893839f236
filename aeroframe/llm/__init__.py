"""Training-data operators (secret scans, extraction, dedup, packing, ...).

Nothing else in the library imports this subpackage.
"""
