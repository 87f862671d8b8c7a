"""Reading and writing: CSV tables, chunk folders, file listings, staged tables."""
