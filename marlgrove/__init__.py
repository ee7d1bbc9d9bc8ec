"""A Spark-native engine for scoring, searching and reporting on document corpora."""
