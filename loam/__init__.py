"""loam: document-collection analytics on Spark."""
