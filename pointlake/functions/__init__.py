"""Column expressions: vectors, matrices and principal axes."""
