"""stratum: warehouse, profiling and data-quality operators on PySpark DataFrames."""
