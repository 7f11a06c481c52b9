"""Operators on streams of points."""
