"""Operators on frames, pixels, tables and grids."""
