"""Incremental maintenance of the co-occurrence index."""
