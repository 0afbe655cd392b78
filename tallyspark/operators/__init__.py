"""DataFrame to DataFrame operators. Columns play roles that are parameters; nothing collects rows."""
