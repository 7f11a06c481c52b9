"""Spatial terrain analytics on Spark."""
