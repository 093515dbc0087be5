"""Training-data operators: deduplication, filtering, mixing, extraction and token output.

Nothing outside this subpackage imports it; the rest of the library works without it.
"""
