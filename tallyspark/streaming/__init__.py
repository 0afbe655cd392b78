"""Incremental forms of operators that are naturally incremental."""
