"""Column expressions: text cleaning, value parsing and calendar parts."""
