"""Operators of a large-scale training-data pipeline, on Spark.

Nothing outside this folder imports it.
"""
