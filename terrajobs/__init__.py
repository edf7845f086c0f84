"""Spark jobs for geographic enrichment of large tables."""
