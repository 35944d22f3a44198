"""Column expressions: type inference, comparisons, CSV text."""
