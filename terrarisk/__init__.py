"""Site-risk analytics on PySpark."""
