"""Operators of a training-data pipeline: DataFrame in, DataFrame out."""
