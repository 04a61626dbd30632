"""A PySpark-native engine for registries of named routes."""
