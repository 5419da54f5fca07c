"""Document analysis and training-data preparation on PySpark."""
