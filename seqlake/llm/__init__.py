"""Training-data operators: archives, tokens, chat, dedup, filters, mixing and media.

Nothing outside this subpackage imports it.
"""
