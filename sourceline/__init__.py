"""Evidence retrieval and Q&A analytics as Spark DataFrame operators."""
