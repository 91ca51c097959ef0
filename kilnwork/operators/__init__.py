"""Operators on tables of pages, chunks, indexes and queries."""
