"""Column builders (exact decimal metrics, formatting) and the SQL surface."""
