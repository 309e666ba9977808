"""lexforge: search, ranking and measurement over code and text, as PySpark DataFrames."""
