"""A Spark-native engine for document and molecule evidence."""
