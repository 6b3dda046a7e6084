"""Spark-native retrieval, chunking, graph and grounding operators over source code and documents."""
