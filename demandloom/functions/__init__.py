"""Column expressions and the per-series model fits."""
