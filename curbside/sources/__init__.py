"""Readers, writers, staged tables and test-data adapters."""
