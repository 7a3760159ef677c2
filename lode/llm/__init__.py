"""Training-data operators: quality, dedup, licences, extraction, language, tokens, packing, mixing.

Nothing else in the library imports this subpackage.
"""
