"""lodestrata: retrieval analytics over source repositories and text corpora on PySpark."""
