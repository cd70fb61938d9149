"""Brindle plans."""
