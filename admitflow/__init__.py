"""PySpark-native engine for auditable observation-and-decision data."""
