"""Training-data operators: dedup, classifiers, vector search, mixing, token output."""
