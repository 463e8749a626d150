"""End-to-end query plans (Spark) and their independent SQL oracles (DuckDB dialect)."""
