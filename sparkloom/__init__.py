"""A PySpark-native engine for hybrid search: loading, chunking, indexing, retrieval, catalog and job operators."""
