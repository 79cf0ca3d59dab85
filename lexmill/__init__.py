"""Spark-native analytics engine for statute text, question-answer corpora and their reports."""
