"""Subpackage of lorekiln: functions."""
