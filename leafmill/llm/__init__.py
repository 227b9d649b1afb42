"""Training-data operators: one module each, self-contained in this subpackage."""
