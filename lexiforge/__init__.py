"""lexiforge: a Spark-native engine for building, deduplicating and searching term glossaries."""
