"""Column and DataFrame helpers shared by the operators."""
