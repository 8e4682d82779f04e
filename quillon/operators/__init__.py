"""Operators on DataFrames: ingestion, chunking, retrieval, verification, question sets, metrics."""
