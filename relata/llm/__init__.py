"""Operators for training-data pipelines.  Nothing outside this subpackage imports it, except the guarded hook in the entry module."""
