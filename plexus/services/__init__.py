"""Lookups over the built tables."""
