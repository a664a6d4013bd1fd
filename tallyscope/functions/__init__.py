"""Column expressions: scores, grading, colour, text, hashing."""
