"""rankloom: a PySpark-native engine for matching and ranking text documents."""
