"""Column functions: text, identifiers, bibliography, money, dates, nested values."""
