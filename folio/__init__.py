"""Folio: a Spark-native document-intelligence engine (DataFrames in, DataFrames out)."""
