"""Column functions: text, page features, vectors, scores."""
