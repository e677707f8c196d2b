"""Spark-native string extraction, findings analytics and corpus operators."""
