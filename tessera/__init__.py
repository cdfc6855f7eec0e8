"""tessera: a PySpark-native engine for empirical panel research and corpus preparation."""
