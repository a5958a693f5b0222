"""Column expressions, windows and streamed folds shared by the operators."""
