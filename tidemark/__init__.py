"""Tidemark: a small SQL dialect and an ordered key-value store on Spark."""
