"""Column expressions: geohashes, text and byte codecs."""
