"""papersieve."""
