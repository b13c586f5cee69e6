"""Column expressions: number parsing, packet predicates, text."""
