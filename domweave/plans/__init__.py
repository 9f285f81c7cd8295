"""Plans of the page-extraction engine."""
