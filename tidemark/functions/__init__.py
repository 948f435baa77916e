"""Column expressions: dimensions, time parts, ratios and array helpers."""
