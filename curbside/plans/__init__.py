"""End-to-end workflows over the operators."""
