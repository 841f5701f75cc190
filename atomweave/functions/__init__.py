"""Column functions: cells, linear algebra, text, dates and colours."""
