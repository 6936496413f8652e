"""Column helpers (built-in expressions) and the one parity UDF."""
