"""codexmill: a Spark-native engine for book corpora (ingest, clean, search, catalog)."""
