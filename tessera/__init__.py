"""tessera: a PySpark-native engine for agent knowledge kept as a property graph."""
