"""Column functions: dates, coercion, text normalisation and report formatting."""
