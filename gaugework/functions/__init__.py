"""Column functions: keys, units, display forms, vectors."""
