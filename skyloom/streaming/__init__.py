"""Additive statistics over streams."""
