"""Incremental runs over folders that files are dropped into."""
