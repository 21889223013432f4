"""Operators for training-data pipelines over text and tags.  Nothing outside this subpackage imports it."""
