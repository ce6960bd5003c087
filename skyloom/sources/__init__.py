"""Readers and writers of the formats that catalogues come in."""
