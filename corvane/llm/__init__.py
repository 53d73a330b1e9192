"""Operators for training-data pipelines; each module documents its own contract."""
