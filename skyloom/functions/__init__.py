"""Column expressions: sky geometry, text, statistics."""
