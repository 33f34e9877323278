"""Corpus preparation and analytics as Spark DataFrame operators."""
