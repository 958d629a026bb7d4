"""Column expressions: times, windows and the sale contract."""
