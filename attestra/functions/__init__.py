"""Column-level building blocks: text, hashing, JSON, vectors, redaction."""
