"""Declarative changelog pipelines and analytics on Spark."""
