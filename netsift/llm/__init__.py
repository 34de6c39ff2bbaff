"""Training-data operators: PII, extraction, search, quality, tokens, mixing, toxicity, near copies.

Nothing outside this package imports it; it may be deleted as a whole.
"""
