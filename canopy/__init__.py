"""canopy: a Spark-native engine for building and querying code graphs."""
