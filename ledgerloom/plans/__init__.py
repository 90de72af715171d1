"""End-to-end compositions of operators."""
