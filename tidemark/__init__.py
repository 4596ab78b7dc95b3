"""Tidemark: a versioned key-value analytics engine whose state is a Spark query over immutable runs."""
