"""Operators of a training-data pipeline. Nothing else in lexmill imports this subpackage."""
