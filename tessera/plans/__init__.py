"""Catalogue queries by operator family."""
