"""Column and DataFrame operators."""
