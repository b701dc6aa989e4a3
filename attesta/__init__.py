"""attesta: evidence-integrity analytics on PySpark."""
