"""Column expressions: arithmetic, vectors, triangles and codes."""
