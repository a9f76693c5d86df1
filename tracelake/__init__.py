"""Session analytics on PySpark."""
