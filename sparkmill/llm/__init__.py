"""Operators of large training-data pipelines. Nothing outside imports this subpackage."""
