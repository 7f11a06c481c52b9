"""Readers and writers of point files."""
