"""Sparkivist: hybrid retrieval and text-record analytics as PySpark plans."""
