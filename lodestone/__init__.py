"""Lodestone: a Spark-native engine for typed project records, retrieval and context compilation."""
