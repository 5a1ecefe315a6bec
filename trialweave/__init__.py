"""Inference after studies whose decision policy was learned from pooled data, on Spark."""
