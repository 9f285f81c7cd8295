"""Streaming of the page-extraction engine."""
