"""Relational building blocks: null-aware NOT IN, pivots, flags, dimension lookups."""
