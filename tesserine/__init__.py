"""Spark-first engine for evidence-grounded content analysis of text collections."""
