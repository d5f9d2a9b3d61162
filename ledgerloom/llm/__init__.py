"""Operators for building training data: fingerprints, tokens, scoring, mixing, search, filtering.

Nothing outside this subpackage imports it.
"""
