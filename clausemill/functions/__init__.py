"""Column expressions: text, metadata, vectors, risk arithmetic."""
