"""Column functions: vectors, text, scores, dates. All are built-in expressions; none runs Python on rows."""
