"""Vector retrieval and embedding-data operators expressed as Spark plans."""
