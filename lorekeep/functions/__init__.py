"""Column expressions: values, predicates, scores, text, geometry. No Python runs per row here."""
