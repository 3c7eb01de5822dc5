"""PySpark-native command-history analytics."""
