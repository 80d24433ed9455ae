"""Streams of points met with the static gazetteer (an extension)."""
