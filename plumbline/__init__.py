"""Leak-safe dataset building and model evaluation as Spark DataFrame functions."""
