"""Web-archive analytics on PySpark."""
