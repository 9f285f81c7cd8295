"""Sources of the page-extraction engine."""
