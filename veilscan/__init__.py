"""Sensitive-data discovery as Spark DataFrame operators."""
