"""Column functions, table transforms and data checks."""
