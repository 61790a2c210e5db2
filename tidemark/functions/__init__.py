"""Column expressions and numerical kernels."""
