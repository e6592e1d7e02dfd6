"""Code-graph analytics and data processing on PySpark."""
