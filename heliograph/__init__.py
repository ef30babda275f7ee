"""heliograph: a PySpark-native hybrid retrieval, evaluation and corpus engine."""
