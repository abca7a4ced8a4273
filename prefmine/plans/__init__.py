"""Registered queries (Spark side) and their DuckDB oracle SQL."""
