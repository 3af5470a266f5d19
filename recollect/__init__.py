"""Retrieval and memory analytics as Spark plans."""
