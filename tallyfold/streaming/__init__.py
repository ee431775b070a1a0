"""Digests and sets kept up to date from a stream of changes."""
