"""Brindle: hybrid retrieval and corpus processing as Spark plans."""
