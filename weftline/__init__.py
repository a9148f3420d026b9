"""A typed-pipeline engine on PySpark DataFrames."""
