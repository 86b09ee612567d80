"""Column expressions: scoring rules, bonus system scores, names, scalars."""
