"""Writing, guarding and publishing tables, and whole relay jobs."""
