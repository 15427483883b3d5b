"""Operators for training-data pipelines. Optional: nothing outside this subpackage imports it."""
