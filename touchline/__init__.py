"""A PySpark-native analytics engine for football decision support."""
