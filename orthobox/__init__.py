"""A Spark-first engine for N-dimensional axis-aligned boxes and points."""
