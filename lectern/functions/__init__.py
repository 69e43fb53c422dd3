"""Column functions: text, vectors and folds, all of built-in expressions."""
