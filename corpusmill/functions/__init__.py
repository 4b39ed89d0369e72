"""Column functions: text forms, dates and numerals, edit distances, arrays."""
