"""A Spark-native analytics engine: guarded SQL, models as functions, provenance and versioned tables."""
