"""Tensor analytics on Spark: tensors are DataFrames, contractions are joins with aggregations."""
