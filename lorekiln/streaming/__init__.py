"""Subpackage of lorekiln: streaming."""
