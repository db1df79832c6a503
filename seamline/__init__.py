"""seamline: redundant-stream merging and corpus preparation on PySpark."""
