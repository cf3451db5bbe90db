"""marlstone: a Spark-native engine for regulatory text: cleaning, chunking, indexing, retrieval, review."""
