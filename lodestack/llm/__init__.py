"""Training-data operators: tokenising, filtering, fingerprints, dedup, sharding and packing.

Nothing outside this package imports it.
"""
