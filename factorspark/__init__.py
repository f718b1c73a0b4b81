"""Batch jobs for equity multi-factor research on Spark: DataFrames in, DataFrame out."""
