"""Foliant: a PySpark engine for document knowledge bases."""
