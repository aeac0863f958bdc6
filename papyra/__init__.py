"""Spark-native analytics over corpora of versioned documents."""
