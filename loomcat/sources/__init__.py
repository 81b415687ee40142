"""Captured pages, documents, configurations, dumps and stored tables."""
