"""Training-data operators: deduplication, decontamination, scoring, mixing, sharding.

Nothing outside this subpackage imports it.
"""
