"""Plans over unbounded input."""
