"""siltworks: document ingestion, storage and retrieval as Spark DataFrame operators."""
