"""Operators for training-data pipelines over the corpus tables; nothing else in the library imports them."""
