"""clueforge: a PySpark-native engine for text intelligence and corpus processing."""
