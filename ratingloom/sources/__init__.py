"""Schemas, readers, writers and literal tables."""
