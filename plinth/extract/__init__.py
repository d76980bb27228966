"""Rows from source text."""
