"""Column expressions: tokens, keys, salts, partition numbers."""
