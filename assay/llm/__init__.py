"""Operators of a text-corpus pipeline: mixing, near-dedup, packing, scans, language id, token counts, quality."""
