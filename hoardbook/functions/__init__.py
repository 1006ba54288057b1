"""Column expressions: text, numbers, card fields, report texts and orderings."""
