"""Operators for preparing training data: packing, search, joins on shingles, mixing, extraction, dedup, counting, scoring."""
