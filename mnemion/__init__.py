"""Spark-first analytics for events, documents, graphs and vectors."""
