"""Tidemark: fresh, reusable query context and training-data operators on Spark DataFrames."""
