"""Column functions: text normalisation, legal extraction, hash embeddings."""
