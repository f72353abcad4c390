"""Column expressions and text rules of the type heuristics."""
