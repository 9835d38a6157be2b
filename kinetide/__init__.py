"""Wearable time-series analytics expressed as Spark DataFrame, SQL and streaming plans."""
