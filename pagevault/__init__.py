"""A Spark-native document archive: ingest, index, search, retain and stream."""
