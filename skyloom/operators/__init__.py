"""Relational operators of the catalogue engine."""
