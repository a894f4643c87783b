"""Readers of package, markup and page-description files."""
