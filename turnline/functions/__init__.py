"""Column helpers: exact rounding, clock arithmetic and bucket labels."""
