"""Functions that make Columns."""
