"""Patterns and the messages that operators hand on."""
