"""lexmill: document-corpus processing and retrieval as Spark DataFrame plans."""
