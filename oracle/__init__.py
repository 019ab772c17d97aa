"""The same questions asked of DuckDB in plain SQL: the independent side of the correctness check."""
