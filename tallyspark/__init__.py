"""Team-sport analytics on Spark: efficiency factors, causal features, as-of valuation, ratings and filters."""
