"""Column functions: text, hashes, JSON, pinning and hooks."""
