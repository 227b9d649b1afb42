"""Functions of columns: geometry, colors, numbers, strings and PDF functions."""
