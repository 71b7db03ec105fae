"""Semantic retrieval, catalog and chat analytics as PySpark DataFrame operations."""
