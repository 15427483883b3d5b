"""Subpackage of lorekiln: sources."""
