"""Lodestack: hybrid document search and corpus processing as Spark plans."""
