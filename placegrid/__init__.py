"""Listings analytics as Spark DataFrame operators."""
