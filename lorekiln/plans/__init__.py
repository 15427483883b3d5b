"""Execution helpers: sessions, staged tables, ordered neighbours."""
