"""Column expressions with the guards of the feature definitions."""
