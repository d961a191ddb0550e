"""A PySpark-native engine for feeds of short, timestamped text records."""
