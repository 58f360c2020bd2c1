"""Reading raw extracts and links, and storing the typed tables."""
