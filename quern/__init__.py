"""A PySpark-native analytics engine: search, filter, ranking, change-feed and stateful operators."""
