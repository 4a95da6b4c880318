"""Column functions: text, shingles and hashes, URLs."""
