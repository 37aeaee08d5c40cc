"""Column expressions: names and documents, declared types, vectors."""
