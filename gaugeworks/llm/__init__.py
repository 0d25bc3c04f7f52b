"""Training-data operators: dedup, language ID, extraction, filters, mixing and packing.

Nothing outside this subpackage imports it; its queries are in ``queries``.
"""
