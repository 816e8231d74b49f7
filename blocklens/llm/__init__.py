"""Training-data operators: dedup, PII, packing, token counts, language, toxicity, search and mixing.

Nothing else in the library imports this subpackage; it can be removed as a whole.
"""
