"""Readers of tables, nested records and files."""
