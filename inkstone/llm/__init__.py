"""Training-data operators: language id, near-dedup, packing, line dedup, encoding,
vector search, sharding, quality rules, toxicity and secret scans.

Nothing outside this subpackage imports it.
"""
