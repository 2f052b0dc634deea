"""Operators on fact tables, documents and text."""
