"""tessera: a Spark-native engine for a compact SQL dialect over versioned Parquet tables."""
