"""Column functions: money, dates, text and review scores. All are built-in expressions."""
