"""Column expressions: nothing here runs anything."""
