"""Column functions: columns in, a column out."""
