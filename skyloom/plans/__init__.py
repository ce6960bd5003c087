"""Whole queries: the operators bound to tables."""
