"""Operators for training-data pipelines on whole corpora; nothing else in the library imports this package."""
