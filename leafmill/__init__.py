"""Page-content analytics as DataFrame transformations."""
