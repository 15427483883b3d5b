"""Subpackage of lorekiln: operators."""
