"""Column expressions: engine-sensitive helpers (exprs) and the business rules (rules)."""
