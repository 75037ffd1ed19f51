"""Operators for training-data pipelines; nothing else in quern imports this package."""
