"""Training-data operators: quality, toxicity, dedup, PII, LM scoring, mixing, packing.

Nothing outside this subpackage imports it.
"""
