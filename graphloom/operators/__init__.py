"""Operators on tables of nodes and edges."""
