"""Incremental forms of two batch operators."""
