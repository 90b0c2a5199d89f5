"""Batch pipelines: canonical graphs, synonym clusters, co-occurrence and statistics tables."""
