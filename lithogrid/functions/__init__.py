"""Column expressions and vectorised helpers used by the operators."""
