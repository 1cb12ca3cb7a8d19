"""Gleanery: recovery, deduplication and auditing of web articles on Spark."""
