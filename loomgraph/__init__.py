"""PySpark-native structural graph analytics."""
