"""Column expressions: text, dates, weather labels, geography, vectors."""
