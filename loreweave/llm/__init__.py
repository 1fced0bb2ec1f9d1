"""Training-data operators: language, quality, toxicity, duplicates, leaks, mixing, chat, WARC, tokens.

Nothing outside this subpackage imports it.
"""
