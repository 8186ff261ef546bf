"""lexmill: a Spark-native engine for a corpus of legal documents."""
