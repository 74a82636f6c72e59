"""gridmend: a PySpark-native engine that finds and mends damaged cells in tables."""
