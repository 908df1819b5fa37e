"""Column expressions and DataFrame helpers that the operators share."""
