"""PySpark-native engine for building and querying a geographic event directory."""
