"""Functions of the page-extraction engine."""
