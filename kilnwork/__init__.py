"""Spark jobs for preparing a document collection and searching it."""
