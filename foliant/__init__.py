"""foliant: document-corpus analytics on PySpark."""
