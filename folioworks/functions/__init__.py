"""Column functions: text normalisation and field parsing."""
