"""Column functions: text, identity, dates, rounding."""
