"""Relational operators of the build: normalising, keys, column codecs, tokens, search, checks."""
