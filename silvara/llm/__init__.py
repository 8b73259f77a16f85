"""Operators for text and large-scale algorithms of training-data pipelines; nothing outside this package imports them."""
