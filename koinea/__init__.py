"""Spark-native analytics for lexical generality over parallel, multi-variety text corpora."""
