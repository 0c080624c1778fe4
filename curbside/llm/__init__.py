"""Operators for building training data out of documents and vectors; nothing outside this package imports it."""
