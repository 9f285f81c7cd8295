"""Operators of the page-extraction engine."""
