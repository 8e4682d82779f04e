"""Document retrieval, question-answering evaluation and training-data preparation on Spark."""
