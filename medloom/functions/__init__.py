"""Column builders: text rules, assertions, vectors, similarities."""
