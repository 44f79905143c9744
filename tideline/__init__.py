"""Spark-first document retrieval, knowledge graph and training-corpus analytics."""
