"""Readers, writers and the table lens."""
