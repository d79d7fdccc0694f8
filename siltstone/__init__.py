"""siltstone: a PySpark-native analytics engine for code and document corpora."""
