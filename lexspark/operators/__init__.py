"""Jobs over tables: chunking, retrieval, similarity, collection management, analytics."""
