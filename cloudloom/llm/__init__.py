"""Training-data operators: decontamination, extraction, dedup, tokens, scores, search.

Nothing else in the library imports this package.
"""
