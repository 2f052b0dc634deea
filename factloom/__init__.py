"""Code-fact analytics on PySpark."""
