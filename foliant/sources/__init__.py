"""Readers and writers: landed files to tables with fixed schemas, and back."""
