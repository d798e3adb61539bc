"""Column functions: text analysis, regular expressions, zero values."""
