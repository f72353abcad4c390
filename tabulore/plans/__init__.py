"""Whole runs: a path or a DataFrame to a data dictionary, and its renderings."""
