"""Operators for training-data pipelines on Spark; nothing else in the package imports this subpackage."""
