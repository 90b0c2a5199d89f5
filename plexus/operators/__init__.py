"""Graph operators: expansion, overlays, filters, matching, ranking, ordering, inference, paths."""
