"""lodestone: a PySpark-native engine for code question-answering corpora."""
