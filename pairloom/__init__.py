"""pairloom: a PySpark engine for measuring paired and single-sided text corpora."""
