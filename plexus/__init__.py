"""A PySpark-native engine for querying, enriching and ranking property graphs."""
