"""Readers, writers and the graph made of the driver tables."""
