"""Registered queries and what they share."""
