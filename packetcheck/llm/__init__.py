"""Operators for training data: each is its own module, queries.py registers them."""
